"""Named tables in versions: a version is written beside the one in use, then a pointer goes over to it.

The pointer is a small file of JSON in the shared store, replaced by a rename. Readers see the whole old or the whole new
version; several tables read at one time are pinned together.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymap.session import remove

ACTIVE, PREVIOUS, DROPPED = "active", "previous", "dropped"


def content_digest(df: DataFrame) -> str:
    """What a table says, whatever its order: sums of hashes over all rows."""
    told = F.struct(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")).alias(f"c{i}") for i, c in enumerate(sorted(df.columns))))
    sums = [F.sum(F.xxhash64(told, F.lit(seed)).cast("decimal(38,0)")).cast("string") for seed in range(3)]
    return df.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums), 256)).first()[0]


class Store:
    """Versions of named tables below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._of = jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._bytes = jvm.org.apache.commons.io.IOUtils

    def versions(self, name: str) -> list[dict]:
        """The kept versions of a table, the newest last: id, digest, status, at, rows."""
        file = self._of(f"{self.path}/{name}/_versions.json")
        if not self._fs.exists(file):
            return []
        stream = self._fs.open(file)
        try:
            return json.loads(self._bytes.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, name: str, versions: list[dict]) -> None:
        new, file = self._of(f"{self.path}/{name}/_versions.{uuid.uuid4().hex}"), self._of(f"{self.path}/{name}/_versions.json")
        out = self._fs.create(new)
        out.write(bytearray(json.dumps(versions).encode()))
        out.close()
        self._fs.delete(file, False)
        if not self._fs.rename(new, file):
            raise OSError(f"the versions of {name} could not be replaced")

    def active(self, name: str) -> dict | None:
        return next((v for v in reversed(self.versions(name)) if v["status"] == ACTIVE), None)

    def write(self, name: str, df: DataFrame, at: float | None = None) -> dict:
        """A new active version; the one before is kept as previous. A table that says the same stays as it is."""
        id = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{name}/{id}")
        written = self.spark.read.parquet(f"{self.path}/{name}/{id}")
        made = {"id": id, "digest": content_digest(written), "status": ACTIVE, "at": time.time() if at is None else at, "rows": written.count()}
        old = self.versions(name)
        if (now := self.active(name)) and now["digest"] == made["digest"]:
            remove(self.spark, f"{self.path}/{name}/{id}")
            return now
        self._point(name, [v | {"status": PREVIOUS if v["status"] == ACTIVE else v["status"]} for v in old] + [made])
        return made

    def read(self, name: str, id: str | None = None, checked: bool = False) -> DataFrame:
        """A version, the active one unless another is named; ``checked`` compares what is there with its digest."""
        version = self.active(name) if id is None else next((v for v in self.versions(name) if v["id"] == id), None)
        if version is None:
            raise KeyError(f"{name} has no version {id or 'in use'}")
        df = self.spark.read.parquet(f"{self.path}/{name}/{version['id']}")
        if checked and content_digest(df) != version["digest"]:
            raise ValueError(f"{name} {version['id']} is not what was written")
        return df

    def pinned(self, names: list[str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """Tables and their digests as they are at one time: the pointers are read again until none moved meanwhile."""
        while True:
            before = {n: self.active(n) for n in names}
            frames = {n: self.read(n, v["id"]) for n, v in before.items() if v}
            if {n: self.active(n) for n in names} == before:
                return frames, {n: v["digest"] for n, v in before.items() if v}

    def rollback(self, name: str, id: str) -> dict:
        """An older version, copied as the active one; if it says the same as that, nothing is done."""
        return self.write(name, self.read(name, id))

    def prune(self, name: str, days: float, now: float | None = None) -> int:
        """Deletes versions out of use for longer than ``days``; how many."""
        since = (time.time() if now is None else now) - days * 86400
        versions = self.versions(name)
        ends = {a["id"]: b["at"] for a, b in zip(versions, versions[1:], strict=False)}
        old = [v for v in versions if v["status"] != ACTIVE and ends.get(v["id"], v["at"]) < since]
        if old:
            self._point(name, [v for v in versions if v not in old])
            for v in old:
                remove(self.spark, f"{self.path}/{name}/{v['id']}")
        return len(old)

    def replace_list(self, name: str, items: DataFrame) -> dict:
        """A word list as a whole, each item with its place and the list's revision, one higher than before."""
        revision = 1 + (self.read(name).agg(F.max("revision")).first()[0] or 0 if self.active(name) else 0)
        return self.write(name, items.withColumn("revision", F.lit(revision)))

    def upsert(self, name: str, rows: DataFrame, key: list[str], order: list[str], keep: int | None = None) -> dict:
        """Rows added to a table: the newest of each key stays, and of those the newest ``keep``."""
        every = self.read(name).unionByName(rows) if self.active(name) else rows
        return self.write(name, newest(every, key, order, keep))

    def upsert_and_drop(self, name: str, rows: DataFrame, key: list[str], present: DataFrame) -> dict:
        """New values for keys, and only keys that are still ``present``."""
        old = self.read(name).join(rows.select(*key), key, "left_anti") if self.active(name) else rows.limit(0)
        return self.write(name, old.unionByName(rows).join(present.select(*key).distinct(), key, "left_semi"))


def newest(rows: DataFrame, key: list[str], order: list[str], keep: int | None = None) -> DataFrame:
    """The newest row of each key by ``order``, and of those the newest ``keep``; aggregated before anything is dealt."""
    one = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")
    return one if keep is None else one.orderBy(*(F.desc(c) for c in order)).limit(keep)


def newest_of_owner(rows: DataFrame, owner: str, order: list[str], keep: int) -> DataFrame:
    """The newest ``keep`` rows of each owner; cut in every task before an owner's rows meet."""
    place = F.row_number().over(Window.partitionBy(owner).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_qm_place", place).where(F.col("_qm_place") <= keep).drop("_qm_place")


def stale(served: dict[str, str], now: dict[str, str], names: list[str]) -> list[str]:
    """The inputs whose digest is no longer the one that is served."""
    return [n for n in names if served.get(n) != now.get(n)]
