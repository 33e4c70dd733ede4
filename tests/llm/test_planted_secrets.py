"""Recall and precision of the entropy spans on planted keys and look-alikes."""

import random
import string
import uuid

from pyspark.sql import functions as F

from arborql.llm import secrets

ALNUM = string.ascii_letters + string.digits


def planted(each: int, seed: int = 11) -> list[tuple[int, bool, str, str]]:
    """(doc_id, is a key, kind, text): random keys of eight kinds, and what only looks like one, in prose."""
    r = random.Random(seed)
    pick = lambda a, n: "".join(r.choice(a) for _ in range(n))
    words = [pick(string.ascii_lowercase, r.randrange(3, 10)) for _ in range(300)]
    word = lambda: r.choice(words)
    keys = {
        "mixed 20": (ALNUM, 20), "mixed 24": (ALNUM, 24), "mixed 32": (ALNUM, 32), "mixed 40": (ALNUM + "/+", 40), "base36": (string.ascii_lowercase + string.digits, 32),
        "base32": (string.ascii_uppercase + "234567", 32), "hex": ("0123456789abcdef", 32), "upper hex": ("0123456789ABCDEF", 40),
    }
    decoys = {
        "prose": lambda: " ".join(word() for _ in range(12)), "camel": lambda: "".join(word().capitalize() for _ in range(5)), "snake": lambda: "_".join(word() for _ in range(5)),
        "path": lambda: "/".join(word() for _ in range(6)) + ".html", "uuid": lambda: str(uuid.UUID(int=r.getrandbits(128))), "number": lambda: pick(string.digits, 30), "repeat": lambda: pick("ab", 2) * 20,
        "date": lambda: f"2024-01-{r.randrange(1, 29):02}T10:20:30.{r.randrange(10 ** 6):06}Z", "url": lambda: f"https://{word()}.example.com/{word()}?id={r.randrange(10 ** 6)}",
    }
    made = [(True, k, lambda a=a: pick(*a)) for k, a in keys.items()] + [(False, k, f) for k, f in decoys.items()]
    rows = [(good, k, " ".join([*(word() for _ in range(6)), f(), *(word() for _ in range(6))])) for good, k, f in made for _ in range(each)]
    return [(i, *x) for i, x in enumerate(rows)]


def test_planted(spark):
    rows = planted(100)
    out = secrets.digests(spark.createDataFrame([(i, t) for i, _, _, t in rows], "doc_id long, text string"))
    spans = {r.doc_id: (r.n_hex, "entropy" in r.spans) for r in out.select("doc_id", "n_hex", "spans").collect()}
    keys = [i for i, good, *_ in rows if good]
    assert sum(any(spans[i]) for i in keys) >= 0.98 * len(keys)
    # runs of 24 digits or of a to f are hex by the fixed patterns; the entropy finds nothing in any of them
    assert not [k for i, good, k, _ in rows if not good and spans[i][1]]
    assert {k for i, good, k, _ in rows if not good and spans[i][0]} <= {"number", "repeat"}
