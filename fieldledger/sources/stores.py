"""Append-only JSONL stores, registry snapshots, optional and ordered JSON scans, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validate import errors_of, repeated_ids


class StoreError(ValueError):
    """A store holds records that its contract does not allow."""


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array file; a missing file is empty, an unreadable one is an error (never silently empty)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_files(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """All files of a pattern with `_file`, so that later steps can keep the order of file names."""
    if not _exists(spark, pattern):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_file", T.StringType())]))
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(pattern).withColumn("_file", F.col("_metadata.file_name"))


def last_file_wins(rows: DataFrame, key: str) -> DataFrame:
    """One row a key, from the last file by name; within a file the greatest columns."""
    rest = [c for c in rows.columns if c not in (key, "_file")]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("_file", *rest)).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])


def present_keys(raw: str):
    """array<string>: the keys a raw JSON object states, null values included."""
    return F.json_object_keys(F.col(raw))


def union_sources(*frames: DataFrame) -> DataFrame:
    """Sources of unlike columns as one frame; lacking columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


class Store:
    """A folder of JSONL files under one JSON Schema. Records are checked before they are written and when read."""

    def __init__(self, spark: SparkSession, path: str, contract: dict, schema: T.StructType):
        self.spark, self.path, self.contract, self.schema = spark, path, contract, schema

    def raw(self) -> DataFrame:
        """(raw, _file, _pos): non-blank lines; the position orders lines of one file. A missing store is empty."""
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], "raw string, _file string, _pos long")
        lines = self.spark.read.text(self.path)
        return lines.select(F.col("value").alias("raw"), F.col("_metadata.file_name").alias("_file"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % (1 << 33)).alias("_pos")).filter("trim(raw) <> ''")

    def check(self) -> DataFrame:
        """(raw, errors) of every line that breaks the contract, and of every repeated id."""
        lines = self.raw()
        bad = lines.select("raw", errors_of("raw", self.contract).alias("errors")).filter(F.size("errors") > 0)
        ids = lines.select("raw", F.get_json_object("raw", "$.id").alias("id"))
        twice = ids.join(repeated_ids(ids), "id").select("raw", F.array(F.concat(F.lit("$.id: repeated "), "id")).alias("errors"))
        return bad.unionByName(twice)

    def read(self) -> DataFrame:
        """The records, or StoreError if any breaks the contract."""
        first = self.check().limit(3).collect()
        if first:
            raise StoreError("; ".join(f"{r['errors'][0]} in {r['raw'][:80]}" for r in first))
        return self.raw().select(F.from_json("raw", self.schema).alias("r"), "_file", "_pos").select("r.*", "_file", "_pos")

    def append(self, records: DataFrame) -> int:
        """Write records (one JSON object each, null fields left out, keys sorted) after checking them; the number written."""
        fields = sorted(records.columns)
        raw = records.select(F.to_json(F.struct(*fields)).alias("raw")).cache()
        try:
            bad = raw.select("raw", errors_of("raw", self.contract).alias("errors")).filter(F.size("errors") > 0).limit(3).collect()
            if bad:
                raise StoreError("; ".join(r["errors"][0] for r in bad))
            ids = raw.select(F.get_json_object("raw", "$.id").alias("id"))
            known = self.raw().select(F.get_json_object("raw", "$.id").alias("id"))
            if repeated_ids(ids).limit(1).count() or ids.join(known, "id", "left_semi").limit(1).count():
                raise StoreError("$.id: repeated")
            raw.write.mode("append").text(self.path)
            return raw.count()
        finally:
            raw.unpersist()


def new_id(prefix: str):
    """Column: prefix and twelve letters or digits, drawn anew for each row."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.regexp_replace(F.expr("uuid()"), "-", ""), 1, 12))


def now_text():
    """Column: the present instant as UTC text with milliseconds and Z."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def save_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class CachedBase:
    """A snapshot held ready, and read anew once its folder or file has changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._seen, self._df = spark, path, None, None

    def _changed_at(self) -> int:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        top = fs.getFileStatus(p)
        return max([top.getModificationTime(), *[x.getModificationTime() for x in (fs.listStatus(p) if top.isDirectory() else [])]])

    def get(self) -> DataFrame:
        at = self._changed_at()
        if at != self._seen:
            if self._df is not None:
                self._df.unpersist()
            self.spark.catalog.refreshByPath(self.path)
            self._df, self._seen = load_snapshot(self.spark, self.path).cache(), at
        return self._df


def manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, bytes, sha256) of every input file, read in parallel; only digests leave the executors."""
    found = [p for p in paths if _exists(spark, p)]
    if not found:
        return spark.createDataFrame([], "file string, bytes long, sha256 string")
    files = spark.read.format("binaryFile").load(found)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def save_json(df: DataFrame, path: str) -> None:
    """The rows as JSON lines with sorted keys, for pages and other consumers."""
    export_json(df).write.mode("overwrite").text(path)


def export_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text with sorted keys, for pages and other consumers."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))
