"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are the roles. A line shows a speaker marker (of the row's role column for its first line, or written
in the line: "User:", "### Assistant", "<|system|>", "Q:") and line features (a question, a list or code mark,
its length). Viterbi finds the roles. Long conversations are cut into segments of rows: a segment's best
paths between any two states form a matrix, matrices multiply (max, plus), and so every segment is decoded on
its own, with the states at its ends known, to exactly the path that one pass would find."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ["system", "user", "assistant", "tool"]
K = len(ROLES)
#: Turns of a segment, and characters of its texts where it has more than one turn.
TURNS_A_SEGMENT, CHARS_A_SEGMENT = 256, 4_000_000
#: Names that speakers go by.
NAMES = {
    "system": 0, "sys": 0, "instructions": 0, "user": 1, "human": 1, "q": 1, "question": 1, "prompter": 1, "you": 1, "customer": 1,
    "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "a": 2, "answer": 2, "model": 2, "agent": 2, "chatbot": 2, "tool": 3, "function": 3, "observation": 3,
}
_WORDS = "|".join(sorted(NAMES, key=len, reverse=True))
MARKER = re.compile(rf"^\s*(?:<\|?(?:im_start\|>)?\s*({_WORDS})\|?>|#+\s*({_WORDS})\s*:?\s*(?:$|\n)|(?:\*\*|\[)?({_WORDS})(?:\*\*|\])?\s*:(?:\*\*)?)\s*", re.I)
LISTED = re.compile(r"^\s*(?:[-*•]|\d+[.)]|```|>)")

#: P(marker = role), and of no marker, given the role of a line that starts a turn, and of one that goes on.
RIGHT, WRONG = math.log(0.97), math.log(0.01)
GOES_ON = math.log(0.85)
#: log P(next role | role) where a turn may change.
TURN = np.log(np.array([[0.05, 0.85, 0.08, 0.02], [0.01, 0.08, 0.88, 0.03], [0.01, 0.85, 0.06, 0.08], [0.01, 0.06, 0.88, 0.05]]))
START = np.log(np.array([0.3, 0.6, 0.08, 0.02]))
#: log P(feature | role): question, list or code, long line.
QUESTION = np.log(np.array([0.05, 0.4, 0.12, 0.01]))
NOT_QUESTION = np.log(1 - np.exp(QUESTION))
LIST = np.log(np.array([0.1, 0.05, 0.2, 0.4]))
NOT_LIST = np.log(1 - np.exp(LIST))
LONG = np.log(np.array([0.3, 0.3, 0.55, 0.5]))
NOT_LONG = np.log(1 - np.exp(LONG))


def lines_of(role: str | None, text: str | None) -> list[tuple[int, bool, str]]:
    """(marker or -1, whether it starts the row, the line without its marker) of each line of a row."""
    known = NAMES.get((role or "").strip().lower(), -1)
    out = []
    for k, line in enumerate((text or "").split("\n")):
        m = MARKER.match(line)
        if m:
            out.append((NAMES[next(g for g in m.groups() if g).lower()], k == 0, line[m.end():]))
        else:
            out.append((known if k == 0 else -1, k == 0, line))
    return out


def codes(role: str | None, text: str | None) -> list[int]:
    """What the model sees of each line, as a small number."""
    return [(m + 1) | first << 3 | line.rstrip().endswith("?") << 4 | bool(LISTED.match(line)) << 5 | (len(line) > 120) << 6
            for m, first, line in lines_of(role, text)]


def _steps() -> np.ndarray:
    """steps[code][a, b]: log weight of going from role a to role b on a line that shows ``code``."""
    out = np.zeros((128, K, K))
    for c in range(128):
        m, first = (c & 7) - 1, c >> 3 & 1
        emit = (QUESTION if c >> 4 & 1 else NOT_QUESTION) + (LIST if c >> 5 & 1 else NOT_LIST) + (LONG if c >> 6 & 1 else NOT_LONG)
        if 0 <= m < K:
            emit = emit + np.where(np.arange(K) == m, RIGHT, WRONG)
        move = TURN
        if not first and m < 0:  # a line inside a row without a marker mostly goes on
            move = np.where(np.eye(K, dtype=bool), GOES_ON, math.log((1 - math.exp(GOES_ON)) / (K - 1)))
        out[c] = move + emit[None, :]
    return out


STEPS = _steps()


def matrix(seen: list[int]) -> np.ndarray:
    m = STEPS[seen[0]]
    for c in seen[1:]:
        m = (m[:, :, None] + STEPS[c][None]).max(axis=1)
    return m


def begin(code: int) -> np.ndarray:
    """The first line of a conversation: START instead of a move."""
    return START + STEPS[code][1] - TURN[1] if code >> 3 & 1 or (code & 7) else START


def path(seen: list[int], enter: int | None, leave: int | None) -> list[int]:
    """Viterbi within a segment; enter is the state before it (None: the conversation begins here), leave the
    state at its end (None: the best)."""
    d = begin(seen[0]) if enter is None else STEPS[seen[0]][enter]
    back = []
    for c in seen[1:]:
        go = d[:, None] + STEPS[c]
        back.append(go.argmax(axis=0))
        d = go.max(axis=0)
    now = int(d.argmax()) if leave is None else leave
    out = [now]
    for b in reversed(back):
        now = int(b[now])
        out.append(now)
    return out[::-1]


def _segments(batches, names):
    """(seg, rows) of each segment, whose rows stand together; seg is the first name."""
    key, rows = None, []
    for b in batches:
        for r in zip(*[b.column(n).to_pylist() for n in names]):
            if r[0] != key:
                if rows:
                    yield key, rows
                key, rows = r[0], []
            rows.append(r)
    if rows:
        yield key, rows


def recover(df: DataFrame, tables) -> DataFrame:
    """conv_id, turn, part, role, said, canonical: the turns of each row of df(conv_id, turn, role, text), in order.

    A row whose text holds several speakers is cut into parts, numbered from 0; ``role`` is the recovered one,
    ``said`` its text without markers, ``canonical`` the rendered turn. Rows of a conversation go by turn (null
    first), then by a hash of role and text, so repeated rows stay, next to each other. A null or unknown role shows no
    marker; a null text is one empty line; rows with a null conv_id are one conversation. An empty table gives
    an empty result; extra columns are not looked at."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = df.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.xxhash64("role", "text").alias("h"), "role", "text")
    # ranges of one order over all rows, so that neither a conversation nor a turn has to fit in one of them
    dealt = src.repartitionByRange(n, "conv", "turn", "h").sortWithinPartitions("conv", "turn", "h", "role", "text")
    dealt = dealt.select("conv", "turn", "role", "text", F.spark_partition_id().cast("long").alias("part"))

    def observe(batches):
        """Rows with their segment, numbered in order over the whole table: a conversation's next rows, TURNS_A_SEGMENT and
        CHARS_A_SEGMENT at most."""
        seg, conv, at, chars = -1, None, 0, 0
        for b in batches:
            out, held = [], 0
            for c, turn, role, text, part in zip(*[b.column(x).to_pylist() for x in ("conv", "turn", "role", "text", "part")]):
                size = len(text or "")
                if seg < 0 or c != conv or at == TURNS_A_SEGMENT or at and chars + size > CHARS_A_SEGMENT:
                    seg, conv, at, chars = (part << 40 if seg < 0 else seg + 1), c, 0, 0
                out.append({"conv": c, "seg": seg, "turn": turn, "at": at, "seen": codes(role, text), "role": role, "text": text})
                at, chars, held = at + 1, chars + size, held + size
                if held > CHARS_A_SEGMENT:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv", pa.int64()), ("seg", pa.int64()), ("turn", pa.int64()), ("at", pa.int64()), ("seen", pa.list_(pa.int32())), ("role", pa.string()), ("text", pa.string())])
    seen = tables.write(dealt.mapInArrow(observe, "conv long, seg long, turn long, at long, seen array<int>, role string, text string"))

    def again(d: DataFrame) -> DataFrame:
        return d.repartition(n, "seg").sortWithinPartitions("seg", "at")

    def matrices(batches):
        for seg, rows in _segments(batches, ["seg", "conv", "seen"]):
            every = [c for r in rows for c in r[2]]
            yield pa.RecordBatch.from_pylist([{"conv": rows[0][1], "seg": seg, "first": every[0], "m": matrix(every).ravel().tolist(), "rest": matrix(every[1:]).ravel().tolist() if len(every) > 1 else []}], small)

    small = pa.schema([("conv", pa.int64()), ("seg", pa.int64()), ("first", pa.int32()), ("m", pa.list_(pa.float64())), ("rest", pa.list_(pa.float64()))])
    mats = again(seen.select("conv", "seg", "at", "seen")).mapInArrow(matrices, "conv long, seg long, first int, m array<double>, rest array<double>")
    mats = mats.repartition(n, "conv").sortWithinPartitions("conv", "seg")

    def ends(batches):
        def solve(rows):
            d, back = begin(rows[0][2]), []
            if rows[0][4]:
                d = (d[:, None] + np.array(rows[0][4]).reshape(K, K)).max(axis=0)
            for r in rows[1:]:
                go = d[:, None] + np.array(r[3]).reshape(K, K)
                back.append(go.argmax(axis=0))
                d = go.max(axis=0)
            now, out = int(d.argmax()), []
            for k in range(len(rows) - 1, -1, -1):
                enter = int(back[k - 1][now]) if k else None
                out.append({"conv": rows[k][0], "seg": rows[k][1], "enter": enter, "leave": now})
                now = enter
            return pa.RecordBatch.from_pylist(out, known)

        now, rows = 0, []
        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in ("conv", "seg", "first", "m", "rest")]):
                if rows and r[0] != now:
                    yield solve(rows)
                    rows = []
                now = r[0]
                rows.append(r)
        if rows:
            yield solve(rows)

    known = pa.schema([("conv", pa.int64()), ("seg", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32())])
    at = mats.mapInArrow(ends, "conv long, seg long, enter int, leave int").select(F.col("seg").alias("s"), "enter", "leave")
    both = seen.join(at, F.col("seg") == F.col("s")).drop("s")

    def render(batches):
        for _, rows in _segments(batches, ["seg", "conv", "turn", "seen", "role", "text", "enter", "leave"]):
            states = path([c for r in rows for c in r[3]], rows[0][6], rows[0][7])
            out, k = [], 0
            for r in rows:
                part, now, said = 0, None, []

                def close():
                    text = "\n".join(said)
                    out.append({"conv_id": rows[0][1], "turn": r[2], "part": part, "role": ROLES[now], "said": text, "canonical": f"<|{ROLES[now]}|>\n{text.strip()}\n<|end|>"})

                for marker, _, line in lines_of(r[4], r[5]):
                    s = states[k]
                    k += 1
                    if now is not None and s != now:
                        close()
                        part, said = part + 1, []
                    now = s
                    said.append(line)
                close()
            yield pa.RecordBatch.from_pylist(out, turns)

    turns = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("said", pa.string()), ("canonical", pa.string())])
    return again(both).mapInArrow(render, "conv_id long, turn long, part int, role string, said string, canonical string")
