"""Publication by content, safe for several publishers and for readers in flight.

Rows lie under ``data/year=/kind=/fingerprint=/run=``, each run of a publisher in folders of its own, and are never changed. What
is published is an index: a small file a version, which names a fingerprint and a run for each (year, kind). A version is
written beside its place and put there by a rename that fails if the version exists, so of two publishers one is first; the
other reads the new index, puts its own kinds into it and tries the next version. Nobody's kinds are lost. Data and versions that
the newest index no longer needs stay for a grace period, so that a reader that planned its scan before goes on.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.publish import fingerprint

ATTEMPTS, GRACE_S = 20, 3600.0
KEYS = "year int, kind string, fingerprint string, run string"


class Index:
    """The versions under a publication's path: one small file each, a row a year and kind."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path, self.make, self.jvm = path, jvm.org.apache.hadoop.fs.Path, jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self.make(path).getFileSystem(conf)
        root = self.files.makeQualified(self.make(path))
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)
        self.plain_rename = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _file(self, version: int):
        return self.make(f"{self.path}/index/{version:012d}.json")

    def versions(self) -> dict[int, float]:
        """Version and time of writing."""
        folder = self.make(f"{self.path}/index")
        if not self.files.exists(folder):
            return {}
        found = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self.files.listStatus(folder)]
        return {int(name[:12]): at for name, at in found if re.fullmatch(r"\d{12}\.json", name)}

    def read(self, version: int) -> dict[tuple, tuple]:
        """(year, kind) to (fingerprint, run)."""
        stream = self.files.open(self._file(version))
        try:
            rows = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return {(year, kind): (mark, run) for year, kind, mark, run in rows}

    def newest(self) -> tuple[int, dict[tuple, tuple]]:
        version = max(self.versions(), default=0)
        return version, self.read(version) if version else {}

    def commit(self, version: int, index: dict[tuple, tuple]) -> bool:
        """Put the version in its place; False if another publisher was first."""
        beside = self.make(f"{self.path}/index/.{uuid.uuid4().hex}.tmp")
        stream = self.files.create(beside, False)
        stream.write(bytearray(json.dumps([[*k, *v] for k, v in sorted(index.items(), key=repr)]).encode()))
        stream.close()
        try:
            self.context.rename(self.files.makeQualified(beside), self.files.makeQualified(self._file(version)), self.plain_rename)
            return True
        except Py4JJavaError as e:
            self.files.delete(beside, False)
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False

    def clear(self, grace_s: float) -> None:
        """Remove versions that were replaced more than the grace period ago, and data of that age which none of the others names."""
        times, limit = sorted(self.versions().items()), time.time() - grace_s
        gone = [v for (v, _), (_, replaced) in zip(times, times[1:]) if replaced <= limit]
        named = {entry for v, _ in times if v not in gone for entry in self.read(v).values()}
        for status in self.files.globStatus(self.make(f"{self.path}/data/year=*/kind=*/fingerprint=*/run=*")) or []:
            mark, run = (part.split("=", 1)[1] for part in status.getPath().toString().rstrip("/").split("/")[-2:])
            if (mark, run) not in named and status.getModificationTime() / 1000 <= limit:
                self.files.delete(status.getPath(), True)
        for v in gone:
            self.files.delete(self._file(v), False)


def _frame(spark: SparkSession, index: dict[tuple, tuple]) -> DataFrame:
    return spark.createDataFrame([(*k, *v) for k, v in index.items()], KEYS)


def published(spark: SparkSession, path: str) -> DataFrame:
    """year, kind and fingerprint of what is published under ``path``."""
    return _frame(spark, Index(spark, path).newest()[1]).drop("run")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The rows that the newest index names."""
    named = F.broadcast(_frame(spark, Index(spark, path).newest()[1]))  # one row for each year and kind
    return spark.read.parquet(f"{path}/data").join(named, ["year", "kind", "fingerprint", "run"], "left_semi").drop("fingerprint", "run")


def publish(df: DataFrame, path: str, whole: bool = False, grace_s: float = GRACE_S) -> DataFrame:
    """Write each (year, kind) whose content changed and an index that names it; returns the new index.

    Equal content is no write at all. A (year, kind) that the input lacks stays, or goes if the input is the ``whole``
    publication. Where two publishers change the same (year, kind), the later index counts. Empty input is an error."""
    spark, data = df.sparkSession, [c for c in df.columns if c not in ("year", "kind")]
    rows = df.withColumn("_row", F.to_json(F.struct(*data)))
    made = {(r.year, r.kind): r.fingerprint for r in fingerprint(rows, ["year", "kind"], "_row").collect()}  # one row for each year and kind
    if not made:
        raise FileNotFoundError("nothing to publish")
    index, run, written = Index(spark, path), uuid.uuid4().hex, set()
    for _ in range(ATTEMPTS):
        version, old = index.newest()
        changed = {k for k, mark in made.items() if old.get(k, (None,))[0] != mark}
        new = {**({} if whole else old), **{k: (made[k], run) if k in changed else old[k] for k in made}}
        if new == old:
            return published(spark, path)
        if more := changed - written:
            keys = F.broadcast(spark.createDataFrame([(*k, made[k], run) for k in more], KEYS))  # one row for each year and kind
            df.join(keys, ["year", "kind"]).write.mode("append").partitionBy("year", "kind", "fingerprint", "run").parquet(f"{path}/data")
            written |= more
        if index.commit(version + 1, new):
            index.clear(grace_s)
            return published(spark, path)
    raise RuntimeError(f"other publishers were first {ATTEMPTS} times")
