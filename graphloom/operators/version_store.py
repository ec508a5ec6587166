"""A table with versions: an append-only log of what each one changed, in a folder.

delta/version=N has a row for each key that version N put or dropped, log/version=N one row
about it, snapshot/version=N a whole state once it was compacted. The log row is written last, so
a version that was interrupted is not there, and of two writers of one number the second
fails. Each log row carries a checksum over the one before, its own fields and a digest of
its delta (sums of parts of the rows' SHA-256, which any order of rows and tasks gives again),
so a change of any earlier byte is found from there on.

The state as of a version is what its keys were last put to: a snapshot and the deltas behind
it, one aggregation by key."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

LOG = "version long, label string, author string, description string, puts long, drops long, digest string, checksum string"
_PART = 15  # hexadecimal digits of a SHA-256 that are summed


def _digest(rows: Column) -> list[Column]:
    """Sums that any order of rows gives: of four parts of each row's SHA-256."""
    sha = F.sha2(rows, 256)
    return [F.coalesce(F.sum(F.conv(F.substring(sha, 1 + _PART * k, _PART), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"d{k}") for k in range(4)]


def _text(key: str, columns: list[str]) -> Column:
    return F.to_json(F.struct(F.col(key).alias("key"), "op", *[c for c in columns if c != key]), {"ignoreNullFields": "false"})


class VersionStore:
    """Versions 1, 2, ... of a table with one row for each value of `key` (not null)."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType) -> None:
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        self.columns = schema.names

    def _read(self, kind: str, schema) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def log(self) -> DataFrame:
        """One row a version."""
        found = self._read("log", LOG)
        return self.spark.createDataFrame([], LOG) if found is None else found

    def _entries(self) -> list:
        return sorted(self.log().collect(), key=lambda r: r.version)  # a row for each version

    def version_of(self, label: str) -> int:
        """Of a label or a tag; the latest that has it."""
        tags = self._read("tag", "tag string, version long")
        named = self.log().where(F.col("label") == label).select("version")
        if tags is not None:
            named = named.union(tags.where(F.col("tag") == label).select("version"))
        got = named.agg(F.max("version")).first()[0]
        if got is None:
            raise KeyError(label)
        return got

    def tag(self, version: int, name: str) -> None:
        self.spark.createDataFrame([(name, version)], "tag string, version long").coalesce(1).write.mode("append").parquet(f"{self.path}/tag")

    # -- writing ---------------------------------------------------------------------------

    def commit(self, rows: DataFrame, label: str, *, author: str = "", description: str = "") -> int:
        """rows become the new version's state; only what differs is written."""
        entries = self._entries()
        new = rows.select(self.columns)
        if not entries:
            return self._append(new.withColumn("op", F.lit("put")), entries, label, author, description)
        old = self.restored(entries[-1].version).select(F.col(self.key).alias("_k"), F.struct(*self.columns).alias("_old"))
        both = new.select(F.struct(*self.columns).alias("_new"), F.col(self.key).alias("_j")).join(old, F.col("_j") == F.col("_k"), "full_outer")
        changed = both.where(~F.col("_new").eqNullSafe(F.col("_old")))
        row = F.coalesce("_new", "_old")
        delta = changed.select(*[row[c].alias(c) for c in self.columns], F.when(F.col("_new").isNull(), "drop").otherwise("put").alias("op"))
        return self._append(delta, entries, label, author, description)

    def changed(self, puts: DataFrame, label: str, *, drops: DataFrame | None = None, author: str = "", description: str = "") -> int:
        """A version by its mutations: rows that are put, and keys that are dropped."""
        delta = puts.select(*self.columns, F.lit("put").alias("op"))
        if drops is not None:
            delta = delta.unionByName(drops.select(self.key, F.lit("drop").alias("op")), allowMissingColumns=True)
        return self._append(delta, self._entries(), label, author, description)

    def _append(self, delta: DataFrame, entries: list, label: str, author: str, description: str) -> int:
        version = entries[-1].version + 1 if entries else 1
        place = f"{self.path}/delta/version={version}"
        # what an interrupted commit of this number left is replaced
        delta.select(*self.columns, "op").write.mode("overwrite").parquet(place)
        puts, drops, digest = self._summed(self._delta(version))
        checksum = self._checksum(entries[-1].checksum if entries else "", version, label, author, description, puts, drops, digest)
        row = [(version, label, author, description, puts, drops, digest, checksum)]
        self.spark.createDataFrame(row, LOG).drop("version").coalesce(1).write.parquet(f"{self.path}/log/version={version}")
        return version

    def _delta(self, version: int) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("op", StringType())])).parquet(f"{self.path}/delta/version={version}")

    def _summed(self, delta: DataFrame) -> tuple[int, int, str]:
        r = delta.agg(F.count_if(F.col("op") == "put"), F.count_if(F.col("op") == "drop"), *_digest(_text(self.key, self.columns))).first()
        return r[0], r[1], ":".join(r[2:])

    @staticmethod
    def _checksum(*fields) -> str:
        return hashlib.sha256(json.dumps(fields).encode()).hexdigest()

    # -- reading ---------------------------------------------------------------------------

    def _snapshots(self) -> list[int]:
        rows = self._read("snapshot-log", "version long")
        return sorted(r.version for r in rows.collect()) if rows is not None else []

    def restored(self, version: int) -> DataFrame:
        """The table as of a version."""
        entries = [r.version for r in self._entries()]
        if version not in entries:
            raise KeyError(version)
        base = max((v for v in self._snapshots() if v <= version), default=0)
        behind = [v for v in entries if base < v <= version]
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshot/version={base}").select(F.lit(base).alias("v"), F.lit("put").alias("op"), F.struct(*self.columns).alias("row"))] if base else []
        parts += [self._delta(v).select(F.lit(v).alias("v"), "op", F.struct(*self.columns).alias("row")) for v in behind]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.union(part)
        if len(parts) == 1:
            last = whole
        else:
            last = whole.groupBy(F.col(f"row.`{self.key}`").alias("_k")).agg(F.max_by(F.struct("op", "row"), "v").alias("x")).select("x.*")
        return last.where("op = 'put'").select("row.*")

    def compact(self, version: int) -> None:
        """Write the whole state of a version, from which later ones are restored."""
        if version in self._snapshots():
            return
        self.restored(version).write.mode("overwrite").parquet(f"{self.path}/snapshot/version={version}")
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.path}/snapshot-log")

    def history(self, key) -> DataFrame:
        """version, op and row of every change of a key."""
        delta = self._read("delta", StructType([*self.schema.fields, StructField("op", StringType())]).add("version", "long"))
        known = self.log().select("version")
        return delta.where(F.col(self.key) == key).join(F.broadcast(known), "version", "left_semi").select("version", "op", F.struct(*self.columns).alias("row"))

    def verified(self) -> list[tuple[int, bool]]:
        """Whether each version's delta and log row are what its checksum, and those of all
        before it, were made from."""
        before, out, sound = "", [], True
        for r in self._entries():
            found = self._summed(self._delta(r.version))
            sound = sound and found == (r.puts, r.drops, r.digest) and r.checksum == self._checksum(before, r.version, r.label, r.author, r.description, *found)
            out.append((r.version, sound))
            before = r.checksum
        return out
