"""A keyed table for streams: rows in hash buckets, and a manifest for each batch that tells the files of every bucket.

A batch reads and writes the buckets of its own keys only, so its cost follows its rows and not the table. It becomes
visible by one rename of its manifest; a batch that is run again starts from the manifest before its own and gives the
same table. Nothing is there before the first batch, and reading gives no rows then.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetloom.session import cut_lineage, delete_path, forget
from fleetloom.sources.files import names, publish_text, read_text


def _with_keys_of(rows: DataFrame, like: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``rows`` that have (left_semi) or have not (left_anti) the keys of a row of ``like``; null equals null."""
    other = like.select([F.col(key).alias(f"_other_{key}") for key in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"_other_{key}")) for key in keys])
    return rows.join(other, same, how)


class KeyedTable:
    """Rows of ``schema`` by ``keys``, as the batches leave them.

    The number of buckets is fixed when the table is first written; choose it for the size of the table, some hundred
    megabytes a bucket. A bucket that was appended to ``merge_at`` times is written as one when next touched. Manifests
    and files that only manifests older than the last ``history`` use are deleted.
    """

    def __init__(self, path: str, schema: str, keys: list[str], buckets: int = 16, merge_at: int = 16, history: int = 8):
        self.path, self.keys, self.buckets, self.merge_at, self.history = path.rstrip("/"), keys, buckets, merge_at, history
        self.schema = StructType.fromDDL(schema)

    def _versions(self, spark: SparkSession) -> list[int]:
        found = names(spark, f"{self.path}/manifests")
        return sorted(int(name.removesuffix(".json")) for name in found if name.endswith(".json"))

    def manifest(self, spark: SparkSession, below: int | None = None) -> dict:
        """The newest manifest, or the newest one of a batch before ``below``."""
        versions = [v for v in self._versions(spark) if below is None or v < below]
        if not versions:
            return {"version": -1, "of": self.buckets, "buckets": {}, "notes": {}}
        return json.loads(read_text(spark, f"{self.path}/manifests/{versions[-1]}.json"))

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _touched(self, rows: DataFrame, buckets: int) -> list[int]:
        """At most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket(buckets)).distinct().collect())

    def _files(self, spark: SparkSession, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """Rows of all buckets, or of some."""
        chosen = manifest["buckets"] if buckets is None else {str(b): manifest["buckets"].get(str(b), []) for b in buckets}
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folders in chosen.items() for folder in folders]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The table after its last batch, or after batch ``version``."""
        return self._files(spark, self.manifest(spark, None if version is None else version + 1))

    def like(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """What the table held before batch ``before`` under the keys of ``rows``; only their buckets are read."""
        manifest = self.manifest(rows.sparkSession, before)
        if not manifest["buckets"]:
            return rows.sparkSession.createDataFrame([], self.schema)
        held = self._files(rows.sparkSession, manifest, self._touched(rows, manifest["of"]))
        return _with_keys_of(held, rows, self.keys, "left_semi")

    def _write(self, spark: SparkSession, rows: DataFrame, version: int, of: int) -> tuple[str, set[str]]:
        """The folder that was written and the buckets there."""
        folder = f"{version}-{uuid.uuid4().hex}"
        out = rows.select(*self.schema.names, self.bucket(of).alias("bucket"))
        # buckets are spread by size: a large one is many files, small ones share a task
        out.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        found = names(spark, f"{self.path}/data/{folder}")
        return folder, {name.removeprefix("bucket=") for name in found if name.startswith("bucket=")}

    def _commit(self, spark: SparkSession, version: int, manifest: dict, buckets: dict, written: tuple[str, set[str]], notes: dict | None) -> None:
        told = {"version": version, "of": manifest["of"], "buckets": buckets, "notes": manifest["notes"] | (notes or {})}
        told |= {"written": written[0], "written_buckets": sorted(written[1])}
        publish_text(spark, f"{self.path}/manifests/{version}.json", json.dumps(told))
        self._clean(spark)

    def _clean(self, spark: SparkSession) -> None:
        versions = self._versions(spark)
        if len(versions) <= 2 * self.history:
            return
        read = {v: json.loads(read_text(spark, f"{self.path}/manifests/{v}.json")) for v in versions[-self.history :]}
        used = {folder for m in read.values() for folders in m["buckets"].values() for folder in folders} | {m["written"] for m in read.values()}
        for v in versions[: -self.history]:
            delete_path(spark, f"{self.path}/manifests/{v}.json")
        for folder in set(names(spark, f"{self.path}/data")) - used:
            delete_path(spark, f"{self.path}/data/{folder}")

    def merge(self, rows: DataFrame, version: int, notes: dict | None = None, gone: DataFrame | None = None) -> None:
        """Batch ``version`` puts ``rows`` in place of what the table holds under their keys, and under those of ``gone``.

        Rows that were written already, by :func:`fleetloom.session.cut_lineage`, are not written once more.
        """
        spark = rows.sparkSession
        manifest = self.manifest(spark, version)
        settled = hasattr(rows, "written_path")
        changed = rows if settled else cut_lineage(rows.select(*self.schema.names))
        buckets, out = manifest["buckets"], changed
        if buckets:
            out_of = changed if gone is None else changed.select(*self.keys).unionByName(gone.select(*self.keys))
            touched = self._touched(out_of, manifest["of"])
            held = _with_keys_of(self._files(spark, manifest, touched), out_of, self.keys, "left_anti")
            out = held.unionByName(changed.select(*self.schema.names))
            buckets = {b: folders for b, folders in buckets.items() if int(b) not in touched}
        written = self._write(spark, out, version, manifest["of"])
        self._commit(spark, version, manifest, buckets | {b: [written[0]] for b in written[1]}, written, notes)
        if not settled:
            forget(changed)

    def append(self, rows: DataFrame, version: int) -> DataFrame:
        """Batch ``version`` adds ``rows``, which are returned as written; only where a bucket has become many files is
        read, and written as one, what is there."""
        spark = rows.sparkSession
        manifest = self.manifest(spark, version)
        folder, there = self._write(spark, rows, version, manifest["of"])
        buckets = {b: list(folders) for b, folders in manifest["buckets"].items()}
        for b in there:
            buckets.setdefault(b, []).append(folder)
        full = [int(b) for b in there if len(buckets[b]) > self.merge_at]
        if full:
            merged, _ = self._write(spark, self._files(spark, {"buckets": buckets}, full), version, manifest["of"])
            buckets |= {str(b): [merged] for b in full}
        self._commit(spark, version, manifest, buckets, (folder, there), None)
        return self.written(spark, version)

    def written(self, spark: SparkSession, version: int) -> DataFrame:
        """The rows that batch ``version`` added, or the buckets that it merged."""
        manifest = self.manifest(spark, version + 1)
        return self._files(spark, {"buckets": {b: [manifest["written"]] for b in manifest.get("written_buckets", [])}})
