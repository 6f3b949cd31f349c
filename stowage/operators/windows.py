"""Ranks and running sums: tags, and the layout of packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage import functions as fn
from stowage import model


def tagged_roots(tags: DataFrame, current: str | None = None) -> DataFrame:
    """Of each hash the tag with the lowest revision, then name; without null and empty hashes and the current root."""
    named = tags.where(F.length("hash") > 0).distinct()
    if current is not None:
        named = named.where(F.col("hash") != current)
    first = F.row_number().over(Window.partitionBy("hash").orderBy("revision", "name"))
    return named.withColumn("__r", first).where("__r = 1").drop("__r")


def preview(tags: DataFrame, n: int = 10) -> DataFrame:
    """The first n tags in order of revision, and how many more there are. The limit is the feature."""
    return tags.orderBy("revision", "name").limit(n).withColumn("more", F.lit(max(0, tags.count() - n)))


def pack_layout(objects: DataFrame, per_pack: int = model.PACK_ENTRIES) -> DataFrame:
    """objects (hash, length) with prefix, pack_no and offset: in order of hash, a new pack after per_pack entries.

    Windows run by prefix and second byte; starts come from counts of those, 65,536 rows at most.
    """
    df = objects.select("hash", "length", fn.prefix(F.col("hash")).alias("prefix"), F.substring("hash", 3, 2).alias("__b"))
    part = Window.partitionBy("prefix").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy("prefix", "__b").agg(F.count(F.lit(1)).alias("n")).select("prefix", "__b", F.coalesce(F.sum("n").over(part), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("prefix", "__b").orderBy("hash")) - 1
    df = df.withColumn("__i", inside).join(starts, ["prefix", "__b"])
    df = df.withColumn("pack_no", F.floor((F.col("__start") + F.col("__i")) / per_pack).cast("long"))
    # bytes before: of the pack's earlier second bytes, then of this one's earlier hashes
    sums = df.groupBy("prefix", "pack_no", "__b").agg(F.sum("length").alias("s"))
    before = Window.partitionBy("prefix", "pack_no").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("prefix", "pack_no", "__b", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__bytes"))
    own = F.coalesce(F.sum("length").over(Window.partitionBy("prefix", "pack_no", "__b").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("__own", own).join(sums, ["prefix", "pack_no", "__b"])
    return df.select("prefix", "pack_no", "hash", (F.col("__bytes") + F.col("__own")).cast("long").alias("offset"), "length")
