"""SRC16: documents by URL, status 200 only, file: URLs for tests: for a table of URLs, and as a Python data source of a
few, a partition each."""

from __future__ import annotations

import time
from urllib.parse import urlsplit
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch_one(url: str, timeout: float, tries: int = 1, pause: float = 0.0) -> tuple[str | None, str | None, int]:
    """(text, error, tries made). A remote's failure is a result, not a failed job; what can't get better isn't tried
    again."""
    error = None
    for k in range(1, tries + 1):
        try:
            if urlsplit(url).scheme not in ("http", "https", "file"):
                return None, "scheme", k
            with urlopen(url, timeout=timeout) as r:
                if getattr(r, "status", None) in (200, None):
                    return r.read().decode("utf-8", "replace"), None, k
                error = f"status {r.status}"
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if isinstance(e, (FileNotFoundError, ValueError)) or isinstance(getattr(e, "reason", None), FileNotFoundError) or 400 <= getattr(e, "code", 0) < 500:
                break
        if k < tries:
            time.sleep(pause * k)
    return None, error, k


def fetched(urls: DataFrame, url_col: str = "url", timeout: float = 20.0, tries: int = 3, pause: float = 0.5, lanes: int = 4) -> DataFrame:
    """urls with text, error and tries. Each distinct URL is fetched once, whatever the number of its rows. URLs are dealt by
    host, each host's over ``lanes`` tasks, so that a host is asked by few at once and a large one is not one task's. A
    null URL is an error like any other."""
    lane = F.pmod(F.xxhash64("__url"), F.lit(lanes))
    each = urls.select(F.col(url_col).alias("__url")).where("__url is not null").distinct()
    each = each.withColumns({"__host": F.regexp_extract("__url", r"^[^:]*://([^/?#]*)", 1), "__lane": lane}).repartition("__host", "__lane").select("__url")

    def run(batches):
        for b in batches:
            for url in b.column(0).to_pylist():  # a document at a time, as any may be large
                text, error, n = fetch_one(url, timeout, tries, pause)
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([text], pa.string()), pa.array([error], pa.string()), pa.array([n], pa.int32())], ["__url", "text", "error", "tries"])

    got = each.mapInArrow(run, "__url string, text string, error string, tries int")
    out = urls.join(got, urls[url_col] == F.col("__url"), "left").drop("__url")
    return out.withColumn("error", F.when(F.col(url_col).isNull(), "no url").otherwise(F.col("error")))


class _One(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], timeout: float):
        self.urls, self.timeout = urls, timeout

    def partitions(self):
        return [_One(u) for u in self.urls]

    def read(self, partition):
        text, error, _ = fetch_one(partition.url, self.timeout)
        yield (partition.url, text, error)


class Fetch(DataSource):
    """spark.dataSource.register(Fetch); spark.read.format("fetch").option("urls", "a b").load()"""

    @classmethod
    def name(cls):
        return "fetch"

    def schema(self):
        return "url string, text string, error string"

    def reader(self, schema):
        return _Reader(self.options.get("urls", "").split(), float(self.options.get("timeout", "20")))
