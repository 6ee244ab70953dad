"""Queries that write derived offers in each format and read them back, plus the price-change feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerscope import fixed
from offerscope.operators import canonical as N
from offerscope.plans.quality import _KIND, CANON, FEATURES, SHOWN, _dedupe_sql
from offerscope.plans.sqltext import cases, dbl, over_offers, over_raw, r2
from offerscope.session import shared_dir
from offerscope.sources import offers as IN
from offerscope.sources import sinks as OUT
from offerscope.sources import snapshots as SN
from offerscope.sources.tables import offers, raw_offers, read_table
from offerscope.streaming.feed import price_changes

COLS = list(fixed.CANONICAL_COLUMNS)


def _shown(df):
    return df.select(*[F.col(c).cast("double").alias(c) if c == "price_value" else F.col(c) for c in COLS])


def s1(spark, sf):
    path = shared_dir(spark, "raw-csv")
    writer = raw_offers(spark, sf).select(*COLS).write.options(**OUT.PACKED).option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return _shown(IN.read_offers(spark, path))


def s2(spark, sf):
    """Bare records and documents holding records, in one folder."""
    path = shared_dir(spark, "records-json")
    rows = raw_offers(spark, sf).withColumn("records", F.array(F.struct(*COLS)))
    rows.where("in_stock = 'True'").select("records").write.options(**OUT.PACKED).json(f"{path}/documents")
    rows.where("in_stock <> 'True'").select(*COLS).write.options(**OUT.PACKED).json(f"{path}/bare")
    return _shown(IN.read_offers(spark, f"{path}/*", "json"))


def _metadata(spark, sf, path):
    """Metadata documents, one folder per snapshot month."""
    o = offers(spark, sf)
    m = o.groupBy("snapshot_id").agg(F.max("extracted_at").alias("created_at"), F.count("*").alias("record_count"))
    doc = m.select(F.col("snapshot_id"), F.to_json(F.struct(
        F.when(F.substring("snapshot_id", 6, 2) != "01", F.col("snapshot_id")).alias("id"), "created_at", "record_count")).alias("value"))
    doc.write.partitionBy("snapshot_id").text(path)
    return path


def s3(spark, sf):
    """Catalogue of documents named like the folders they are in; defaults fill what they lack."""
    path = _metadata(spark, sf, shared_dir(spark, "snapshots"))
    return SN.read_snapshots(spark, path, file="*").select("snapshot_id", "created_at", "mode", "brand_scope", "record_count", "is_current")


def s5(spark, sf):
    """One report per snapshot month and retailer, its list exploded."""
    path = shared_dir(spark, "reports")
    per = offers(spark, sf).groupBy("snapshot_id", "retailer").agg(F.count(F.when(F.col("price_value").isNull(), 1)).alias("bad"))
    item = F.struct("retailer", F.when(F.col("bad") > 0, "failed").otherwise("passed").alias("status"), (F.col("bad") > 0).alias("blocked_publication"))
    docs = per.select(F.col("snapshot_id").alias("runtime_name"), F.lit("full").alias("mode"), F.array(item).alias("retailers"))
    docs.write.json(path)
    return SN.read_report(spark, path, multiline=False).select("runtime_name", "retailer", "status", "blocked_publication")


def s6(spark, sf):
    path = shared_dir(spark, "log-lines")
    e = read_table(spark, sf, "events")
    good = e.select(F.to_json(F.struct(F.col("event_id").alias("index"), F.col("event_type").alias("event"))).alias("value"))
    broken = e.where("event_type = 'error'").select(F.concat(F.lit('{"index": '), F.col("event_id").cast("string")).alias("value"))
    good.unionByName(broken).write.text(path)
    return IN.read_lines_after(spark, path, "index long, event string", 100)


def s7(spark, sf):
    path = shared_dir(spark, "targets")
    read_table(spark, sf, "part").select(F.col("p_name").alias("model"), F.col("p_size").alias("capacity_gb"),
                                         F.col("p_brand").alias("brand")).write.json(path)
    return IN.read_targets(spark, path, ["brand#7", "BRAND#9"]).select("model", "capacity_gb", "brand")


def _catalogue(o):
    return o.groupBy("snapshot_id").agg(F.max("extracted_at").alias("created_at"))


def s8(spark, sf):
    """The newest snapshot, read from a table partitioned by snapshot."""
    path = shared_dir(spark, "history")
    offers(spark, sf).drop("_ord").repartition("snapshot_id").write.partitionBy("snapshot_id").parquet(path)
    h = spark.read.schema(offers(spark, sf).drop("_ord").schema).parquet(path)
    return _shown(IN.load_snapshot(h, _catalogue(h)))


def s9(spark, sf):
    path = shared_dir(spark, "canonical-csv")
    OUT.write_canonical(raw_offers(spark, sf), path)
    return _shown(IN.read_offers(spark, path))


def s10(spark, sf):
    path = shared_dir(spark, "raw-run-csv")
    OUT.write_raw(raw_offers(spark, sf), path)
    return _shown(IN.read_offers(spark, path))


def _values(df, kind):
    """Values as read back, empty as null."""
    price = F.nullif(F.col("price_value").cast("string"), F.lit("")).cast("double")
    return df.select(F.lit(kind).alias("kind"), "retailer", "model", F.nullif(F.col("capacity_gb").cast("string"), F.lit("")).cast("int").alias("capacity_gb"), "offer_type",
                     F.nullif(F.col("term_months").cast("string"), F.lit("")).cast("int").alias("term_months"), price.alias("price"), "source_title", "extracted_at")


def s11(spark, sf):
    """Both files, value by value."""
    path = shared_dir(spark, "records")
    OUT.write_records(offers(spark, sf), path)
    return _values(IN.read_csv_text(spark, f"{path}/csv"), "csv").unionByName(_values(spark.read.json(f"{path}/json"), "json"))


def s12(spark, sf):
    path = shared_dir(spark, "unified")
    OUT.write_unified(offers(spark, sf), path, "2001-11.csv")
    read = IN.read_csv_text(spark, path)
    return _values(read.where("source_snapshot = source_snapshots"), "unified").withColumn("source_snapshot", F.lit("2001-11.csv"))


def s13(spark, sf):
    path = shared_dir(spark, "flat")
    OUT.write_flat(offers(spark, sf), path)
    return IN.read_csv_text(spark, path).select("retailer", "model", "offer_type", F.col("term_months").cast("int").alias("term_months"),
                                                F.col("total_cost").cast("double").alias("total_cost"))


def s14(spark, sf):
    root = shared_dir(spark, "published")
    rows = N.canonicalize(raw_offers(spark, sf))
    return _shown(SN.publish(spark, rows, root, "2001-11", "2001-11-30T00:00:00+00:00", "scheduled"))


def s14_catalogue(spark, sf):
    root = shared_dir(spark, "published")
    SN.publish(spark, N.canonicalize(raw_offers(spark, sf)), root, "2001-11", "2001-11-30T00:00:00+00:00", "scheduled")
    return SN.catalogue(spark, root).select("snapshot_id", "created_at", "mode", "record_count", "raw_record_count", "published_record_count")


def s15(spark, sf):
    return SN.expired(_catalogue(offers(spark, sf)), 24)


def s16(spark, sf):
    """Manifest of the newest snapshot, written and read back."""
    path = shared_dir(spark, "manifest")
    o = offers(spark, sf)
    snaps = o.groupBy("snapshot_id").agg(F.max("extracted_at").alias("created_at"), F.count("*").alias("record_count")).withColumns(
        {"mode": F.lit("scheduled"), "brand_scope": F.lit("all"), "competitors": F.array(F.lit("Amazon"))})
    newest = snaps.orderBy(F.col("created_at").desc()).limit(1)
    SN.write_manifest(spark, newest, path, cron="0 6 * * *")
    return SN.publish_info(spark, path, snaps).select("current_snapshot_id", "published_at", "record_count", F.col("schedule.kind").alias("kind"), F.col("schedule.cron").alias("cron"))


def s17(spark, sf):
    path = shared_dir(spark, "export")
    OUT.write_export(offers(spark, sf).where("offer_type = 'cash'"), path)
    df = IN.read_csv_text(spark, path)
    return df.select("competidor", "modelo", "modalidad_label", "moneda", "disponibilidad", F.col("capacidad").cast("int").alias("capacidad"),
                     F.col("precio_valor").cast("double").alias("precio_valor"))


def s18(spark, sf):
    return IN.legacy_rows(offers(spark, sf), "brand#7").select("retailer", "model", "capacity_gb", "offer_type", F.col("price_value").cast("double").alias("price"))


def s19(spark, sf):
    """With an empty catalogue the seed file is read."""
    path = shared_dir(spark, "seed")
    OUT.write_raw(raw_offers(spark, sf), path)
    o = offers(spark, sf)
    return IN.current_or_seed(spark, o, _catalogue(o).where(F.lit(False)), path).groupBy("retailer").agg(F.count("*").alias("n"))


QUERIES = {
    "s1_read_csv": s1, "s2_read_records_json": s2, "s3_snapshot_catalogue": s3, "s5_validation_report": s5, "s6_lines_after": s6,
    "s7_read_targets": s7, "s8_load_newest": s8, "s9_canonical_csv": s9, "s10_raw_csv": s10, "s11_records": s11, "s12_unified": s12,
    "s13_flat": s13, "s14_publish": s14, "s14_catalogue_row": s14_catalogue, "s15_expired": s15, "s16_manifest": s16, "s17_export": s17,
    "s18_legacy_rows": s18, "s19_seed": s19,
    "x1_price_changes": lambda spark, sf: price_changes(offers(spark, sf)),
}

_CANON = over_raw(CANON + f" SELECT {SHOWN} FROM canon")
# Reading canonical rows infers a missing capture kind again, now from the canonical retailer name.
_TWICE = over_raw(CANON + f" SELECT {SHOWN} FROM (SELECT * REPLACE ({_KIND} AS price_capture_kind) FROM canon)")
_DEDUPED = over_raw(CANON + FEATURES + f" SELECT {SHOWN} FROM ({_dedupe_sql('reasons')})")

_READ = f"retailer, model, capacity_gb, offer_type, term_months, {dbl('price_value')} AS price, source_title, extracted_at"

ORACLE = {
    "s1_read_csv": _CANON, "s2_read_records_json": _CANON, "s10_raw_csv": _TWICE, "s9_canonical_csv": _DEDUPED, "s14_publish": _DEDUPED,
    "s3_snapshot_catalogue": over_offers("""SELECT snapshot_id, max(extracted_at) AS created_at, 'scheduled' AS mode, 'all' AS brand_scope,
 count(*) AS record_count, snapshot_id = (SELECT max(snapshot_id) FROM offers) AS is_current FROM offers GROUP BY snapshot_id"""),
    "s5_validation_report": over_offers("""SELECT snapshot_id AS runtime_name, retailer, CASE WHEN count(*) FILTER (price_value IS NULL) > 0 THEN 'failed'
 ELSE 'passed' END AS status, count(*) FILTER (price_value IS NULL) > 0 AS blocked_publication FROM offers GROUP BY ALL"""),
    "s6_lines_after": "SELECT event_id AS index, event_type AS event FROM events WHERE event_id >= 100",
    "s7_read_targets": "SELECT p_name AS model, p_size AS capacity_gb, p_brand AS brand FROM part WHERE p_brand IN ('Brand#7', 'Brand#9')",
    "s8_load_newest": over_offers(f"SELECT {SHOWN} FROM offers WHERE snapshot_id = (SELECT max(snapshot_id) FROM offers)"),
    "s11_records": over_offers(f"SELECT kind, {_READ} FROM offers, (SELECT unnest(['csv', 'json']) AS kind)"),
    "s12_unified": over_offers(f"SELECT 'unified' AS kind, '2001-11.csv' AS source_snapshot, {_READ} FROM offers"),
    "s13_flat": over_offers(f"""SELECT retailer, model, offer_type, term_months, CASE WHEN coalesce(term_months, 0) <> 0
 THEN {r2('CAST(price_value AS DOUBLE) * term_months')} ELSE CAST(price_value AS DOUBLE) END AS total_cost FROM offers"""),
    "s14_catalogue_row": over_raw(CANON + FEATURES + f""", d AS ({_dedupe_sql('reasons')}) SELECT '2001-11' AS snapshot_id, '2001-11-30T00:00:00+00:00' AS created_at,
 'scheduled' AS mode, count(*) AS record_count, (SELECT count(*) FROM raw) AS raw_record_count, count(*) AS published_record_count FROM d"""),
    "s15_expired": over_offers("""SELECT snapshot_id, max(extracted_at) AS created_at FROM offers GROUP BY 1 ORDER BY 2 DESC, 1 DESC OFFSET 24"""),
    "s16_manifest": over_offers("""SELECT snapshot_id AS current_snapshot_id, max(extracted_at) AS published_at, count(*) AS record_count, 'daily' AS kind,
 '0 6 * * *' AS cron FROM offers GROUP BY 1 ORDER BY 2 DESC LIMIT 1"""),
    "s17_export": over_offers(f"""SELECT retailer AS competidor, model AS modelo, {cases('offer_type', fixed.MODALITY_LABELS, 'offer_type')} AS modalidad_label,
 'EUR' AS moneda, CASE WHEN in_stock THEN 'True' WHEN NOT in_stock THEN 'False' END AS disponibilidad, capacity_gb AS capacidad, {dbl('price_value')} AS precio_valor
 FROM offers WHERE offer_type = 'cash'"""),
    "s18_legacy_rows": over_offers(f"SELECT retailer, model, capacity_gb, offer_type, {dbl('price_value')} AS price FROM offers WHERE brand = 'Brand#7' AND price_value IS NOT NULL"),
    "s19_seed": over_raw(CANON + " SELECT retailer, count(*) AS n FROM canon GROUP BY 1"),
    "x1_price_changes": over_offers("""SELECT * REPLACE (CAST(price AS DOUBLE) AS price, CAST(previous AS DOUBLE) AS previous) FROM (
 SELECT retailer, model, capacity_gb, offer_type, term_months, snapshot_id, min(price_value) AS price,
 lag(min(price_value)) OVER (PARTITION BY retailer, model, capacity_gb, offer_type, term_months ORDER BY snapshot_id) AS previous
 FROM offers WHERE price_value IS NOT NULL GROUP BY retailer, model, capacity_gb, offer_type, term_months, snapshot_id) WHERE price <> previous"""),
}
