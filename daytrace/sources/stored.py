"""A stored relation that is upserted: buckets of Parquet files and manifests of versions.

A version's manifest names a folder for each bucket of keys. An upsert reads and rewrites only the buckets of its keys, into
a new folder, and then renames the next manifest into place: readers see the old version or the new one, and a writer that
dies before that leaves the old one. Of two writers from one version, the second to rename fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class StoredTable:
    """Rows by key in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self._hadoop.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        """Numbers of the versions there are, ascending."""
        if not self.fs.exists(self._path("versions")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("versions"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _folders(self, version: int) -> dict[int, str]:
        """Folder of each bucket that has rows."""
        if not version:
            return {}
        text = self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first().value
        return {int(b): folder for b, folder in json.loads(text)["buckets"].items()}

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(folders.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the latest; none before the first."""
        every = self.versions()
        return self._rows(self._folders(version if version is not None else every[-1] if every else 0))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Put ``rows`` (one per key) in place of those of equal keys: the rows as stored, with ``replaced``.

        A replaced row passes its columns ``keep`` on. Equal keys include null ones. The driver sees the numbers of the
        buckets alone.
        """
        every = self.versions()
        version = every[-1] if every else 0
        folders = self._folders(version)
        name = uuid.uuid4().hex
        cols = [c for c in self.read(0).columns]
        new = rows.select(*cols)
        touched = {r.b for r in new.select(self._bucket().alias("b")).distinct().collect()}
        old = self._rows({b: f for b, f in folders.items() if b in touched})
        both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        pick = [(F.min_by(F.struct(c), "_new") if c in keep else F.max_by(F.struct(c), "_new"))[c].alias(c) for c in cols if c not in self.keys]
        merged = both.groupBy(*self.keys).agg(*pick, (F.min("_new") == 0).alias("_old"), (F.max("_new") == 1).alias("_put"))
        merged = merged.withColumn("bucket", self._bucket())
        target = f"{self.path}/data/{name}"
        merged.repartition("bucket").select(*cols, "_old", "_put", "bucket").write.partitionBy("bucket").parquet(target)
        self._commit(version, {**folders, **{b: name for b in touched}})
        written = self.spark.read.schema(f"{self.schema}, _old BOOLEAN, _put BOOLEAN").parquet(*[f"{target}/bucket={b}" for b in sorted(touched)]) if touched else self.read(0).withColumns({"_old": F.lit(True), "_put": F.lit(True)})
        return written.where("_put").select(*cols, F.col("_old").alias("replaced"))

    def _commit(self, version: int, folders: dict[int, str]) -> None:
        """Make the next version visible by one rename."""
        draft, final = self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/{version + 1}.json")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps({"buckets": {str(b): f for b, f in folders.items()}}).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise RuntimeError(f"version {version + 1} was written by another writer")
