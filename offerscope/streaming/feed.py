"""Arriving offer files merged batch by batch, and a feed of price changes.

Both are our own addition: the batch operators applied to micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerscope import fixed
from offerscope.operators.merge import merge_validated, selected_keys
from offerscope.operators.ordering import validation_sample
from offerscope.operators.validate import gate


def stream_offers(spark: SparkSession, path: str, schema, per_batch: int = 100) -> DataFrame:
    """Stream of parquet offer files dropped into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def merge_batches(stream: DataFrame, root: str, base: str = fixed.DEFAULT_BASE):
    """Merge every micro-batch into the published table; returns the writer to start.

    Each batch writes a new version folder named by its batch id, so a batch retried after a lost
    executor or driver overwrites its own output only, from the same previous version.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        checks = validation_sample(batch).select("retailer", F.col("price_value").isNotNull().alias("matched"))
        report = gate(checks, batch.select("retailer").distinct())
        if batch_id > 0:
            old = spark.read.parquet(f"{root}/version={batch_id - 1}")
        else:
            old = batch.where(F.lit(False))
        merged = merge_validated(old, batch, report, selected_keys(batch, base))
        # Rows keep their own arrival order; the next batch sorts after them by construction.
        merged.withColumn("_ord", F.col("_ord.row")).write.mode("overwrite").parquet(f"{root}/version={batch_id}")

    return stream.writeStream.foreachBatch(apply)


def price_changes(offers: DataFrame) -> DataFrame:
    """Price against the previous snapshot in which the same retailer offered the same product.

    Snapshots are ordered by their id as text, whatever its form. The window runs over one aggregated row
    per product and snapshot, so a product's group is as long as the catalogue of snapshots at most.
    """
    key = ["retailer", "model", "capacity_gb", "offer_type", "term_months"]
    per = offers.where("price_value IS NOT NULL").groupBy(*key, "snapshot_id").agg(F.min("price_value").alias("price"))
    before = F.lag("price").over(Window.partitionBy(*key).orderBy("snapshot_id"))
    return per.withColumn("previous", before).where("price <> previous").select(
        *key, "snapshot_id", F.col("price").cast("double").alias("price"), F.col("previous").cast("double").alias("previous"))


__all__ = ["merge_batches", "price_changes", "stream_offers"]
