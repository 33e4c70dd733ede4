"""Plain Python versions of the operators, for small inputs. They share no code with arborql.llm."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def component_of(nodes, links) -> dict:
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def embeddings(rows, threshold=0.9):
    """rows: (id, vector or None), unique ids -> {id: (n_links, component, kept)}"""
    ok = {i: v for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = []
    for i, v in ok.items():
        for j, w in ok.items():
            if i < j and len(v) == len(w):
                dot = math.fsum(a * b for a, b in zip(v, w))
                if dot / math.sqrt(math.fsum(a * a for a in v)) / math.sqrt(math.fsum(b * b for b in w)) >= threshold:
                    links.append((i, j))
    n = Counter(x for link in links for x in link)
    comp = component_of([i for i, _ in rows], links)
    return {i: (n[i], comp[i], comp[i] == i) for i, _ in rows}


def base_secrets(text: str) -> list[tuple]:
    spans = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            spans.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            spans.append((m.start(), 2, "hex", m.end()))
    return sorted(spans)


WORD = r"(?:(?:[A-Z]?[a-z]+){1,40}[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,8})"
ALLOWED = re.compile(
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z|(?i:0123456789abcdef|abcdefghijklmnopqrstuvwxyz|example|placeholder|xxxxxxxx|(.)\1{9,})"
    rf"|(?<![A-Za-z0-9+]){WORD}(?:[/_-]{{1,3}}{WORD}){{1,60}}(?![A-Za-z0-9+])|(?<![A-Za-z0-9])(?:[A-Z]?[a-z]{{2,}}+|[A-Z]{{2,4}}(?=[A-Z][a-z])){{3,40}}[0-9]{{0,4}}(?![A-Za-z0-9])")
KINDS = [("[0-9a-f]", 3.0, "[0-9]", "[a-f]"), ("[0-9A-F]", 3.0, "[0-9]", "[A-F]"), ("[a-z0-9]", 3.4, "[0-9]", "[a-z]"), ("[A-Z0-9]", 3.35, "[0-9]", "[A-Z]")]


def entropy_secrets(text: str) -> list[tuple]:
    """A piece's first to last window of 20 characters that reaches a class's entropy, each counted anew."""
    out = []
    for stretch in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        body, at = stretch[0], 0
        cuts = [m.span() for m in ALLOWED.finditer(body)] + [(len(body), len(body))]
        for a, b in cuts:
            piece, begin, at = body[at:a], stretch.start() + at, b
            tries = [(begin, piece, 3.7, ("[0-9]", "[a-z]", "[A-Z]"))]
            for chars, bits, *must in KINDS:
                tries += [(begin + m.start(), m[0], bits, must) for m in re.finditer(rf"(?<![A-Za-z0-9]){chars}{{20,}}(?![A-Za-z0-9])", piece)]
            hits = [(s + i, s + i + 20) for s, run, bits, must in tries if all(re.search(x, run) for x in must)
                    for i in range(len(run) - 19) if (entropy(run[i:i + 20]) or 0.0) >= bits]
            if hits:
                out.append((min(hits)[0], 3, "entropy", max(e for _, e in hits)))
    return out


def secret_spans(text: str | None) -> str:
    spans = sorted(base_secrets(text or "") + entropy_secrets(text or ""))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def secrets(text: str | None):
    spans = base_secrets(text or "")
    n = Counter(s[2] for s in spans)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans))


def entropy(text: str, window: int = 20) -> float | None:
    best = None
    for i in range(len(text) - window + 1):
        c = Counter(text[i:i + window])
        best = max(best or 0.0, -sum(v / window * math.log2(v / window) for v in c.values()))
    return best


def quality(text: str | None):
    text = text or ""
    w = words(text)
    where = defaultdict(list)
    for i in range(len(w) - 2):
        where[tuple(w[i:i + 3])].append(i)
    repeated = {k for at in where.values() if len(at) > 1 for i in at for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


def near_copies(rows, size: int, percent: int = 80):
    """rows: (id, text), unique ids -> {id: (n_shingles, component, kept)}"""
    sets = {}
    for i, t in rows:
        w = words(lower(t or ""))
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1:])
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = component_of(list(sets), links)
    return {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def targets(sizes: dict, percent: int = 150, weights=(5, 2, 1), times: int = 2) -> dict:
    """{source: words} -> {source: target}"""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, left, open_ = {}, sum(sizes.values()) * percent / 100, set(names)
    while open_:
        all_w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / all_w >= times * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / all_w for s in open_}
            break
        for s in over:
            out[s] = float(times * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def url(u: str | None):
    if u is None or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = lower(host)
    hits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    best = max(hits, key=len, default=None)
    return host, path, best, RULES.get(best)


def lines(rows, least_chars: int = 20, least_docs: int = 3):
    """rows: (id, text), unique ids -> {id: (n_lines, n_dropped, kept text)}"""
    key = lambda x: lower(x.strip(SPACE))
    holds = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                holds[key(x)].add(i)
    out = {}
    for i, t in rows:
        every = (t or "").split("\n")
        stay = [x for x in every if len(h := holds.get(key(x), ())) < least_docs or max(h) == i]
        out[i] = (len(every), len(every) - len(stay), "\n".join(stay))
    return out
