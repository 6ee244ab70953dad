"""Snapshot catalogue, validation reports, publishing, retention, manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerscope import fixed
from offerscope.operators.dedupe import dedupe_by_quality

METADATA = (
    "id string, created_at string, run_id string, mode string, brand_scope string, competitors array<string>, "
    "record_count long, raw_record_count long, published_record_count long, selected_key_count long, "
    "raw_generated_csv string, runtime_name string, validation_report_path string, "
    "retailers_blocked array<string>, retailer_runtime_map map<string,string>, files map<string,string>"
)
REPORT = (
    "runtime_name string, mode string, brand_scope string, requested_competitors array<string>, "
    "retailers_blocked array<string>, selected_key_count long, raw_record_count long, "
    "retailers array<struct<retailer:string, runtime_used:string, status:string, mismatches:array<string>, "
    "blocked_publication:boolean, evidence_urls:array<string>, validated_products:array<struct<brand:string, "
    "model:string, capacity_gb:int, offer_type:string, price_value:double, term_months:int, source_url:string>>>>"
)
MANIFEST = (
    "current_snapshot_id string, published_at string, mode string, brand_scope string, competitors array<string>, "
    "record_count long, schedule struct<kind:string, cron:string, timezone:string>"
)


def read_snapshots(spark: SparkSession, root: str, file: str = "metadata.json") -> DataFrame:
    """One row per ``<root>/<snapshot>/<file>`` with defaults; the newest is current.

    ``file`` may be a pattern. Folders may be named ``<snapshot>`` or ``snapshot_id=<snapshot>``.
    """
    raw = (
        spark.read.schema(METADATA).option("multiLine", True).json(f"{root.rstrip('/')}/*/{file}")
        .withColumn("_path", F.col("_metadata.file_path"))
    )
    folder = F.regexp_extract("_path", r"/(?:snapshot_id=)?([^/]+)/[^/]+$", 1)
    empty = F.array().cast("array<string>")
    out = raw.select(
        F.coalesce(F.nullif("id", F.lit("")), folder).alias("snapshot_id"),
        F.coalesce("created_at", F.lit("")).alias("created_at"), "run_id",
        F.coalesce(F.nullif("mode", F.lit("")), F.lit("scheduled")).alias("mode"),
        F.coalesce(F.nullif("brand_scope", F.lit("")), F.lit("all")).alias("brand_scope"),
        F.coalesce("competitors", empty).alias("competitors"),
        F.coalesce("record_count", F.lit(0)).alias("record_count"),
        F.coalesce("raw_record_count", F.lit(0)).alias("raw_record_count"),
        F.coalesce(F.nullif("published_record_count", F.lit(0)), "record_count", F.lit(0)).alias("published_record_count"),
        F.coalesce("selected_key_count", F.lit(0)).alias("selected_key_count"),
        F.coalesce("retailers_blocked", empty).alias("retailers_blocked"),
        F.regexp_replace("_path", r"/[^/]+$", "").alias("folder"), "files",
    )
    newest = out.agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id"))).scalar()
    return out.withColumn("is_current", F.col("snapshot_id") == newest)


def resolve_file(spark: SparkSession, folder: str, stated: str | None, default: str) -> str:
    """Path of a snapshot's file: absolute if it exists, else inside the snapshot, else as given, else the default."""

    def exists(path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    name = (stated or "").strip()
    absolute = name.startswith("/") or "://" in name
    for candidate in ([name] if absolute else [f"{folder}/{name}", name]) if name else []:
        if exists(candidate):
            return candidate
    return f"{folder}/{default}"


def read_report(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Validation reports, one row per retailer; one document per file, or per line."""
    df = spark.read.schema(REPORT).option("multiLine", multiline).json(path)
    return df.select("runtime_name", F.col("mode").alias("run_mode"), F.inline("retailers"))


def publish(
    spark: SparkSession, records: DataFrame, root: str, snapshot_id: str, created_at: str, mode: str = "manual",
    brand_scope: str = "all", raw_record_count: int | None = None, selected_key_count: int = 0,
) -> DataFrame:
    """Dedupe, write a new version of the snapshot, then the catalogue row that points to it. Fails when nothing is
    publishable.

    A version is written once, to a path of its own, and never changed. Readers follow the newest pointer of each
    snapshot, so a run that stops anywhere before its pointer is written leaves what they see as it was; a
    repeated run adds a version. ``prune`` removes what no pointer leads to any more.
    """
    version = uuid.uuid4().hex
    path = f"{root.rstrip('/')}/history/snapshot_id={snapshot_id}/version={version}"
    rows = dedupe_by_quality(records).select(*fixed.CANONICAL_COLUMNS)
    rows.write.parquet(path)
    written = spark.read.schema(rows.schema).parquet(path)
    if written.isEmpty():
        _delete(spark, path)
        raise RuntimeError("no publishable rows")
    raw = F.lit(raw_record_count) if raw_record_count is not None else records.agg(F.count("*")).scalar()
    meta = written.agg(F.count("*").alias("n")).select(
        F.lit(snapshot_id).alias("id"), F.lit(created_at).alias("created_at"), F.lit(mode).alias("mode"),
        F.lit(brand_scope).alias("brand_scope"), F.col("n").alias("record_count"), raw.cast("long").alias("raw_record_count"),
        F.col("n").alias("published_record_count"), F.lit(selected_key_count).cast("long").alias("selected_key_count"),
        F.create_map(F.lit("records"), F.lit(path)).alias("files"), F.unix_micros(F.current_timestamp()).alias("pointed_at"),
    )
    meta.coalesce(1).write.json(f"{root.rstrip('/')}/catalogue/{snapshot_id}-{version}")
    return written


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    """Every catalogue row ever written, with its own ``_entry`` path."""
    rows = spark.read.schema(f"{METADATA}, pointed_at long").json(f"{root.rstrip('/')}/catalogue/*")
    return rows.withColumn("_entry", F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]+$", "")).withColumnRenamed("id", "snapshot_id")


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """One row per published snapshot: the newest pointer."""
    rows = _pointers(spark, root)
    columns = [c for c in rows.columns if c not in ("snapshot_id", "_entry", "pointed_at")]
    newest = rows.groupBy("snapshot_id").agg(F.max_by(F.struct(*columns), F.struct("pointed_at", "_entry")).alias("m"))
    return newest.select("snapshot_id", "m.*")


def history(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all published snapshots, partitioned by ``snapshot_id``; only versions that a pointer leads to.

    The paths come to the driver, one per snapshot kept.
    """
    paths = [r.path for r in catalogue(spark, root).select(F.col("files")["records"].alias("path")).toLocalIterator()]
    return spark.read.option("basePath", f"{root.rstrip('/')}/history").parquet(*paths).drop("version")


def expired(snapshots: DataFrame, keep: int = fixed.SNAPSHOTS_KEPT) -> DataFrame:
    """Snapshots beyond the newest n: those before the oldest of the n to keep, which is found as a top-k."""
    if keep < 1:
        return snapshots
    age = F.struct(F.coalesce("created_at", F.lit("")).alias("c"), F.coalesce("snapshot_id", F.lit("")).alias("s"))
    oldest = snapshots.select(age.alias("age")).orderBy(F.col("age").desc()).limit(keep).agg(F.min("age")).scalar()
    return snapshots.where(age < oldest)


def prune(spark: SparkSession, root: str, keep: int = fixed.SNAPSHOTS_KEPT) -> list[str]:
    """Delete expired snapshots and versions that were replaced: pointers first, then data. Only paths and ids travel
    to the driver; the ids of expired snapshots are returned."""
    gone = [r.snapshot_id for r in expired(catalogue(spark, root), keep).select("snapshot_id").toLocalIterator()]
    pointers = _pointers(spark, root)
    current = pointers.groupBy("snapshot_id").agg(F.max_by("_entry", F.struct("pointed_at", "_entry")).alias("_entry"))
    replaced = pointers.join(current.select("_entry"), "_entry", "left_anti") if not gone else pointers.join(
        current.where(~F.col("snapshot_id").isin(*gone)).select("_entry"), "_entry", "left_anti")
    for row in list(replaced.select("_entry", F.col("files")["records"].alias("path")).toLocalIterator()):
        _delete(spark, row["_entry"])
        if row["path"]:
            _delete(spark, row["path"])
    return gone


def write_manifest(spark: SparkSession, snapshot: DataFrame, path: str, cron: str | None = None, zone: str = "UTC") -> None:
    """One-row manifest of the published snapshot (a one-row catalogue DataFrame)."""
    snapshot.select(
        F.col("snapshot_id").alias("current_snapshot_id"), F.col("created_at").alias("published_at"), "mode", "brand_scope",
        F.coalesce("competitors", F.array().cast("array<string>")).alias("competitors"), "record_count",
        F.struct(F.lit("daily" if cron else "manual").alias("kind"), F.lit(cron).cast("string").alias("cron"),
                 F.lit(zone).alias("timezone")).alias("schedule"),
    ).coalesce(1).write.mode("overwrite").json(path)


def publish_info(spark: SparkSession, path: str, snapshots: DataFrame) -> DataFrame:
    """The manifest, else the newest snapshot described like one."""
    try:
        info = spark.read.schema(MANIFEST).json(path)
        if not info.isEmpty():
            return info
    except Exception as error:  # a missing manifest is a normal state, anything else is not
        if "PATH_NOT_FOUND" not in str(error):
            raise
    newest = snapshots.orderBy(F.col("created_at").desc(), F.col("snapshot_id").desc()).limit(1)
    return newest.select(
        F.col("snapshot_id").alias("current_snapshot_id"), F.col("created_at").alias("published_at"), "mode", "brand_scope",
        "competitors", "record_count",
        F.struct(F.lit("manual").alias("kind"), F.lit(None).cast("string").alias("cron"), F.lit("UTC").alias("timezone")).alias("schedule"))
