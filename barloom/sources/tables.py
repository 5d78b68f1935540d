"""Readers and writers of canonical tables and value stores."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BAR_SCHEMA = "series_id string, bar_start_ts timestamp, open double, high double, low double, close double, volume double, trade_count long"


def write_canonical(df: DataFrame, root: str, version: str, schema_name: str, root_column: str = "series_id") -> None:
    """<root>/<version>/schema=<name>/root=<series>: readers prune by both; only partitions in df are replaced."""
    out = df.withColumn("schema", F.lit(schema_name)).withColumn("root", F.col(root_column))
    # one task for a root would be too few for a long one: files are dealt by root and month
    dealt = out.repartition("root", F.trunc("bar_start_ts", "month")) if "bar_start_ts" in df.columns else out.repartition("root")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("schema", "root").parquet(f"{root}/{version}")


def read_canonical(spark: SparkSession, root: str, version: str, schema_name: str, symbol: str | None = None, start=None, end=None, ts: str = "bar_start_ts") -> DataFrame:
    """Rows of one schema, of a symbol and a time range [start, end) if given; both filters reach the scan."""
    df = spark.read.parquet(f"{root}/{version}").filter(F.col("schema") == schema_name)
    if symbol is not None:
        df = df.filter(F.col("root") == symbol)
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(ts) < F.lit(end).cast("timestamp"))
    return df.drop("schema", "root")


def read_csv_bars(spark: SparkSession, path: str, schema: str = BAR_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(bars, bad rows): rows that the schema does not fit keep their text in __bad."""
    raw = spark.read.schema(f"{schema}, __bad string").option("header", True).option("columnNameOfCorruptRecord", "__bad").option("mode", "PERMISSIVE").csv(path)
    return raw.filter("__bad is null").drop("__bad"), raw.filter("__bad is not null").select("__bad")


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def sql_over_file(spark: SparkSession, path: str, sql: str, table: str = "data", schema: str | None = None) -> DataFrame:
    """Any SQL over a CSV or Parquet file seen as ``table``."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("header", True).csv(path) if path.endswith(".csv") else reader.parquet(path)
    df.createOrReplaceTempView(table)
    return spark.sql(sql)


def close_summary(bars: DataFrame) -> DataFrame:
    return bars.groupBy("series_id").agg(F.count("*").alias("bars"), F.avg("close").alias("mean_close"))


def content_hash(*columns) -> Column:
    """Order-independent hash of rows as an aggregate: the sum of row hashes as a decimal, with the count."""
    return F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("string"))


def value_stats(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return values.groupBy(*by).agg(F.count("*").alias("rows"), F.count(value).alias("values"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))


MANIFEST = "current.json"
_PACK = "pack string, digest string, n long, values long, first_ts timestamp, last_ts timestamp, least double, most double"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, root: str, version_id: str) -> dict | None:
    """What a version's manifest says of its current pack; None without one."""
    path, fs = _file_system(spark, root)
    at = f"{root}/version_id={version_id}/{MANIFEST}"
    return spark.read.schema(_PACK).json(at).first().asDict() if fs.exists(path(at)) else None


def _publish(spark: SparkSession, folder: str, entry: DataFrame) -> None:
    """Write the manifest beside its place and rename it there: a reader sees the old one or the new one."""
    path, fs = _file_system(spark, folder)
    draft = f"{folder}/_draft-{uuid.uuid4().hex}"
    entry.coalesce(1).write.json(draft)
    part = next(f.getPath() for f in fs.listStatus(path(draft)) if f.getPath().getName().startswith("part-"))
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(part), context.makeQualified(path(f"{folder}/{MANIFEST}")), overwrite)
    fs.delete(path(draft), True)


def write_value_pack(values: DataFrame, root: str, version_id: str, columns: list[str]) -> bool:
    """Write a pack of values as the current one of version_id; one with the same content hash is left as it is (False).

    Packs are folders that never change.  The data are written first, then the
    manifest, which names the pack and holds its hash and statistics, is renamed
    into its place.  A writer that fails before leaves the old pack current, and
    a folder that nothing names.
    """
    spark = values.sparkSession
    folder = f"{root}/version_id={version_id}"
    now = manifest(spark, root, version_id)
    digest = values.agg(content_hash(*columns).alias("h")).first()[0]
    if now is not None and now["digest"] == digest:
        return False
    pack = f"pack-{uuid.uuid4().hex}"
    values.write.parquet(f"{folder}/{pack}")
    value = F.col("value").cast("double")
    stats = spark.read.schema(values.schema).parquet(f"{folder}/{pack}").agg(
        F.lit(pack).alias("pack"), content_hash(*columns).alias("digest"), F.count("*").alias("n"), F.count("value").alias("values"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"), F.min(value).alias("least"), F.max(value).alias("most"),
    )
    _publish(spark, folder, stats)
    return True


def read_value_packs(spark: SparkSession, root: str, version_ids: list[str], since=None, until=None) -> DataFrame:
    """The current packs of the asked versions, with version_id; those whose event times lie outside since..until are not read.

    Rows are not filtered: the times only leave packs out.
    """
    packs = []
    for version in version_ids:
        entry = manifest(spark, root, version)
        if entry is None:
            raise FileNotFoundError(f"no pack of {version}")
        early = since is not None and entry["last_ts"] is not None and entry["last_ts"] < since
        late = until is not None and entry["first_ts"] is not None and entry["first_ts"] > until
        packs.append((version, entry["pack"], early or late))
    read = lambda version, pack: spark.read.parquet(f"{root}/version_id={version}/{pack}").withColumn("version_id", F.lit(version))
    kept = [read(v, p) for v, p, outside in packs if not outside]
    return reduce(DataFrame.unionByName, kept) if kept else read(*packs[0][:2]).filter(F.lit(False))


def drop_old_packs(spark: SparkSession, root: str, version_id: str) -> list[str]:
    """Delete the folders of a version that its manifest does not name; for when no reader or writer is at work."""
    path, fs = _file_system(spark, root)
    entry, folder = manifest(spark, root, version_id), f"{root}/version_id={version_id}"
    old = sorted(f.getPath().getName() for f in fs.listStatus(path(folder)) if f.isDirectory() and (entry is None or f.getPath().getName() != entry["pack"]))
    for name in old:
        fs.delete(path(f"{folder}/{name}"), True)
    return old


def as_of(view: DataFrame, available_ts) -> DataFrame:
    """What was known at a time."""
    return view.filter(F.col("available_ts") <= available_ts)
