"""What stays in memory between queries: one corpus, by the fingerprint of its files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def fingerprint(spark: SparkSession, path: str, *parameters: object) -> tuple | None:
    """The files under a path with their times and sizes, and parameters; None if there are none."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    found, each = [], fs.listFiles(root, True)
    while each.hasNext():
        f = each.next()
        found.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
    return (*sorted(found), *parameters) if found else None


class CorpusCache:
    """One frame, kept while the files it was made from stay as they are; a change of them or of a parameter replaces it."""

    def __init__(self) -> None:
        self.mark: tuple | None = None
        self.frame: DataFrame | None = None

    def get(self, spark: SparkSession, path: str, load: Callable[[], DataFrame], *parameters: object) -> DataFrame:
        mark = fingerprint(spark, path, *parameters)
        if self.frame is None or mark is None or mark != self.mark:
            if self.frame is not None:
                self.frame.unpersist()
            self.mark, self.frame = mark, load().cache()
        return self.frame


class Held:
    """A frame made once and kept for the process, whatever happens to its source; `renew` makes it anew."""

    def __init__(self, load: Callable[[], DataFrame]):
        self.load, self.frame = load, None

    def get(self) -> DataFrame:
        if self.frame is None:
            self.frame = self.load().cache()
        return self.frame

    def renew(self) -> DataFrame:
        if self.frame is not None:
            self.frame.unpersist()
        self.frame = None
        return self.get()
