"""Collections merged by bucket: an upsert rewrites only the buckets that its keys fall into.

A manifest names, for each bucket, the folder that holds its rows.  A writer
reads the newest manifest, writes the merged rows of the buckets it touches to a
folder of its own, and commits by creating the next manifest, which fails if
another writer has created it: then only the buckets that the other one changed
are merged again.  Readers see one manifest or the next, never half of a write.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.store import upsert
from millrace.session import written

_BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Other writers committed first, more often than a writer tries."""


class MergeStore:
    """Collections under one folder, each with its manifests and data.

    The file system must create a file for one of two writers only, as HDFS and
    local ones do; an object store without conditional writes does not.  ``buckets`` counts for collections that this store creates.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, tries: int = 20) -> None:
        self.spark, self.root, self.buckets, self.tries = spark, root.rstrip("/"), buckets, tries

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _load(self, name: str, version: int) -> dict | None:
        """A manifest; None if it isn't whole (yet)."""
        fs, p = self._fs(f"{self.root}/{name}/manifests/{version:012d}.json")
        stream = fs.open(p)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text[:-1]) if text.endswith("\n") else None

    def versions(self, name: str) -> list[int]:
        return [int(n[:-5]) for n in self._names(f"{self.root}/{name}/manifests") if n.endswith(".json")]

    def manifest(self, name: str) -> dict | None:
        """The newest whole manifest: version, key, buckets, folders by bucket."""
        for version in reversed(self.versions(name)):
            if found := self._load(name, version):
                return found
        return None

    def _commit(self, name: str, manifest: dict) -> bool:
        """Create the manifest of its version; False if there is one."""
        fs, p = self._fs(f"{self.root}/{name}/manifests/{manifest['version']:012d}.json")
        text = (json.dumps(manifest, sort_keys=True) + "\n").encode()
        if fs.getUri().getScheme() == "file":
            # Hadoop's local file system looks first and creates then, so two writers may both succeed; "x" is one step
            fs.mkdirs(p.getParent())
            try:
                with open(p.toUri().getPath(), "xb") as out:
                    out.write(text)
            except FileExistsError:
                return False
            return True
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                return False
            raise RuntimeError(f"manifest {p} can't be created") from e
        out.write(bytearray(text))
        out.close()
        return True

    def _rows(self, name: str, folders: list[str]) -> DataFrame:
        # a bucket's folder is read as it is, without its name as a column
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.root}/{name}/{f}" for f in folders))

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """The rows of the newest version, or of an older one that is still there; None without any."""
        found = self.manifest(name) if version is None else self._load(name, version)
        return self._rows(name, sorted(found["folders"].values())) if found and found["folders"] else None

    def _merged(self, name: str, found: dict, new: DataFrame, touched: list[int], key: str) -> dict[str, str]:
        """Write the rows of the touched buckets, old and new; the folder of each."""
        old = [found["folders"][str(b)] for b in touched if str(b) in found["folders"]]
        mine = new.where(F.col(_BUCKET).isin(touched)).drop(_BUCKET)
        rows = mine if not old else self._rows(name, old).join(mine.select(key), key, "left_anti").unionByName(mine, allowMissingColumns=True)
        folder = f"data/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(key), F.lit(found["buckets"]))
        # by ranges of bucket and key, so that a large bucket is several files and a small one no task of its own
        rows.withColumn(_BUCKET, bucket).repartitionByRange(_BUCKET, key).write.partitionBy(_BUCKET).parquet(f"{self.root}/{name}/{folder}")
        return {str(b): f"{folder}/{_BUCKET}={b}" for b in touched}

    def write(self, name: str, points: DataFrame, key: str = "id", order: Column | None = None) -> dict:
        """Upsert ``points``: of rows of one key the last by ``order`` replaces what there is; the new manifest.

        Rows without key are an error; without ``order`` the last row of a key is that
        of the greatest hash, the same whenever it is computed.  Columns that either side lacks are null.  An upsert of nothing commits nothing.
        """
        new = upsert(None, points, key, order)
        found = self.manifest(name) or {"version": 0, "key": key, "buckets": self.buckets, "folders": {}}
        if found["key"] != key:
            raise ValueError(f"collection {name} is keyed by {found['key']}, not {key}")
        new = written(new.withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(found["buckets"]))), "upsert")
        if not new.where(F.col(key).isNull()).isEmpty():
            raise ValueError("rows without key")
        touched = sorted(r[0] for r in new.select(_BUCKET).distinct().collect())  # no more than there are buckets
        if not touched:
            return found
        folders = self._merged(name, found, new, touched, key)
        for _ in range(self.tries):
            following = {**found, "version": found["version"] + 1, "folders": {**found["folders"], **folders}}
            if self._commit(name, following):
                return following
            newer = self._newer(name, found)
            if newer["buckets"] != found["buckets"]:  # both have created the collection
                return self.write(name, points, key, order)
            stale = [b for b in touched if newer["folders"].get(str(b)) != found["folders"].get(str(b))]
            found = newer
            if stale:
                folders |= self._merged(name, found, new, stale, key)
        raise Conflict(f"{name}: {self.tries} writers were faster")

    def _newer(self, name: str, found: dict, wait: float = 60) -> dict:
        """The newest manifest beyond ``found``; one that a writer is just writing is waited for."""
        until = time.time() + wait
        while time.time() < until:
            newest = self.versions(name)[-1]
            if newest > found["version"] and (whole := self._load(name, newest)):
                return whole
            time.sleep(0.05)
        raise Conflict(f"{name}: manifest {self.versions(name)[-1]} was begun and never ended; remove it to go on")

    def vacuum(self, name: str, keep: int = 2, grace: float = 3600) -> list[str]:
        """Remove all but the newest ``keep`` manifests, and data of none of these that is older than ``grace`` seconds; what went.

        Younger data may be that of a writer that hasn't committed yet.
        """
        versions = self.versions(name)
        kept = [m for v in versions[-keep:] if (m := self._load(name, v))]
        used = {f.split("/")[1] for m in kept for f in m["folders"].values()}
        gone = [f"manifests/{v:012d}.json" for v in versions[:-keep]]
        fs, data = self._fs(f"{self.root}/{name}/data")
        if fs.exists(data):
            old = time.time() * 1000 - grace * 1000
            gone += [f"data/{s.getPath().getName()}" for s in fs.listStatus(data) if s.getPath().getName() not in used and s.getModificationTime() <= old]
        for path in gone:
            fs.delete(self._fs(f"{self.root}/{name}/{path}")[1], True)
        return gone
