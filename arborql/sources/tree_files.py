"""Files by name out of rows, all together or not at all: a Python data source whose tasks write aside and whose driver
moves the whole in place once all have ended."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _file_system(path: str):
    """The file system of a path or URL, and the place within it. Of those that pyarrow knows: local, HDFS, and stores."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    """A task writes below a folder of its own attempt, beside the target. Commit moves the files of the attempts that
    counted into one new folder, and then that folder to the target, which must not be there: readers see the whole tree
    or none. Other attempts' files go with the folder beside."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        parent, _, name = self.path.rpartition("/")
        self.aside = f"{parent}/.{name}-{uuid.uuid4().hex}"

    def write(self, rows):
        fs, top = _file_system(f"{self.aside}/{uuid.uuid4().hex}")
        names, out, now = set(), None, None
        for row in rows:
            if row["path"] != now:
                if out is not None:
                    out.close()
                now = row["path"]
                if now in names:
                    raise ValueError(f"rows of {now} are not together")
                if now.startswith("/") or ".." in now.split("/"):
                    raise ValueError(f"path {now}")
                names.add(now)
                fs.create_dir(f"{top}/{now}".rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(f"{top}/{now}")
            out.write((row["line"] + "\n").encode())
        if out is not None:
            out.close()
        return Written(top, sorted(names))

    def commit(self, messages):
        fs, whole = _file_system(f"{self.aside}/whole")
        _, target = _file_system(self.path)
        seen = set()
        fs.create_dir(whole, recursive=True)
        try:
            for m in messages:
                for name in m.names if m is not None else ():
                    if name in seen:
                        raise ValueError(f"two tasks wrote {name}")
                    seen.add(name)
                    fs.create_dir(f"{whole}/{name}".rpartition("/")[0], recursive=True)
                    fs.move(f"{m.folder}/{name}", f"{whole}/{name}")
            if fs.get_file_info(target).type.name != "NotFound":
                raise ValueError(f"{target} exists")
            fs.move(whole, target)
        finally:
            self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        fs, aside = _file_system(self.aside)
        if fs.get_file_info(aside).type.name != "NotFound":
            fs.delete_dir(aside)


class TreeFiles(DataSource):
    """df(path, line).write.format("tree_files").mode("append").save(folder): rows of one path together in a task."""

    @classmethod
    def name(cls):
        return "tree_files"

    def writer(self, schema, overwrite):
        if sorted(schema.names) != ["line", "path"]:
            raise ValueError("columns path and line")
        return _Writer(self.options["path"])


def write_tree(df: DataFrame, folder: str, spread: int | None = None) -> None:
    """df(path, ord, line) as files below ``folder``, lines in order. Paths are dealt over tasks, so a file is one task's."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(TreeFiles)
    n = spread or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(n, "path").sortWithinPartitions("path", "ord").select("path", "line")
    rows.write.format("tree_files").mode("append").save(folder)
