"""Shared pieces: ASCII white space, and distributed connected components."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arborql.tables import Tables

#: ASCII white space of the word definition, as a Java/RE2 character class body and as characters.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n = "_" + n
        out.append(n)
    return out


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system: workers live on between tasks, beside
    those of other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def connected_components(edges: DataFrame, tables: Tables, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (node, component), component being the least node.

    edges(a, b): long node numbers; loops and repeats are allowed, rows with a null end are ignored.
    Nodes without an edge to another node are absent from the result. Alternating large-star and
    small-star rounds keep at most one row an edge; every step is a combinable minimum and an equi-join on a node,
    so a hub's minimum is pre-aggregated; its join is one that adaptive execution splits once it is past its
    threshold of bytes (16 bytes an edge), and stays with one task below it. A round is one action: the fingerprint
    that tells whether anything changed is taken while the round's table is written."""
    e = (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )

    def written(d: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = tables.write(d.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        return out, (seen.get["n"], seen.get["h"])

    e, mark = written(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
        )
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("s"))
            .select("s.*").where("u <> v").distinct()
        )
        new, now = written(small)
        tables.drop(e)
        e = new
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
