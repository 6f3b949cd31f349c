"""Counts, sums and distincts, each a result table: retried tasks count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage import functions as fn
from stowage import model
from stowage.operators.joins import HASH_SUFFIX, pack_copies


def distinct_entries(bag: DataFrame, match: list[str] = HASH_SUFFIX) -> DataFrame:
    return bag.select(*match).dropDuplicates()


def union_all(*bags: DataFrame) -> DataFrame:
    out = bags[0].select("hash", "suffix")
    for b in bags[1:]:
        out = out.unionByName(b.select("hash", "suffix"))
    return out


def duplicates(bag: DataFrame) -> DataFrame:
    """entries, unique_entries and duplicate_entries of a bag; one row a distinct entry is summed, none is kept in memory."""
    each = bag.groupBy("hash", "suffix").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return each.agg(total.alias("entries"), F.count(F.lit(1)).alias("unique_entries"), (total - F.count(F.lit(1))).alias("duplicate_entries"))


def by_suffix(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("suffix").agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def sweep_totals(stored: DataFrame, reachable: DataFrame, match: list[str]) -> DataFrame:
    """checked, retained, candidates, bytes of candidates and the percentage that would go, in one pass over stored."""
    marks = reachable.select(*match).distinct().withColumn("r", F.lit(1))
    gone = F.col("r").isNull()
    agg = stored.join(marks, match, "left").agg(F.count(F.lit(1)).alias("checked"), F.count("r").alias("retained"), F.count_if(gone).alias("candidates"), F.coalesce(F.sum(F.when(gone, F.col("length"))), F.lit(0)).alias("candidate_bytes"))
    return agg.withColumn("percent", F.round(fn.percentage(F.col("candidates"), F.col("checked")), 4))


def compaction_stats(entries: DataFrame, reachable: DataFrame) -> DataFrame:
    """Per prefix: packs read, entries kept and removed (second copies aside), bytes reclaimed."""
    marks = reachable.select("hash").distinct().withColumn("r", F.lit(1))
    df = pack_copies(entries).join(marks, "hash", "left")
    first, live = F.col("copy") == 1, F.col("r") == 1
    out = df.groupBy("prefix").agg(F.countDistinct("pack_id").alias("packs"), F.count_if(first & live).alias("kept"), F.count_if(first & F.col("r").isNull()).alias("removed"), F.sum("length").alias("old"), F.coalesce(F.sum(F.when(first & live, F.col("length"))), F.lit(0)).alias("new"))
    return out.select("prefix", "packs", "kept", "removed", F.greatest(F.col("old") - F.col("new"), F.lit(0)).alias("reclaimed"))


def loose_stats(judged: DataFrame) -> DataFrame:
    gone = ~F.col("kept")
    return judged.agg(F.count_if("kept").alias("kept"), F.count_if(gone).alias("deleted"), F.coalesce(F.sum(F.when(gone, F.col("length"))), F.lit(0)).alias("bytes_freed"))


def unique_count(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("unique_entries"))


def store_totals(entries: DataFrame) -> DataFrame:
    """objects, bytes, packs and the most packs of a prefix."""
    by_pack = entries.groupBy("prefix", "pack_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"))
    by_prefix = by_pack.groupBy("prefix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("p"))
    return by_prefix.agg(F.sum("n").alias("objects"), F.sum("b").alias("bytes"), F.sum("p").alias("packs"), F.max("p").alias("most_packs"))


def fragmented(entries: DataFrame, above: int = model.MERGE_ABOVE) -> DataFrame:
    """Prefixes with more than `above` packs."""
    return entries.groupBy("prefix").agg(F.countDistinct("pack_id").alias("packs")).where(F.col("packs") > above)


def fanout(hashes: DataFrame) -> DataFrame:
    """byte1 (0 to 255) and the hashes whose second byte is that or less; 256 rows in one window."""
    counts = hashes.groupBy(F.conv(F.substring("hash", 3, 2), 16, 10).cast("int").alias("byte1")).agg(F.count(F.lit(1)).alias("n"))
    every = hashes.sparkSession.range(256).select(F.col("id").cast("int").alias("byte1"))
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("byte1").rowsBetween(Window.unboundedPreceding, 0))
    return every.join(counts, "byte1", "left").select("byte1", running.cast("long").alias("total"))


def inventory(stored: DataFrame) -> DataFrame:
    return stored.groupBy("prefix").agg(F.count(F.lit(1)).alias("objects"), F.sum("length").alias("bytes"))


def used_prefixes(stored: DataFrame) -> DataFrame:
    return stored.agg(F.countDistinct("prefix").alias("prefixes"))


def outcomes(found: DataFrame) -> DataFrame:
    """Objects and bytes by outcome of a fetch."""
    return found.groupBy("outcome").agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def mirror_stats(discovered: DataFrame, found: DataFrame, packs: int) -> DataFrame:
    """One row: entries discovered, skipped as they were there, loose, packed, failed, packs written, and bytes fetched."""
    n = lambda outcome: F.count_if(F.col("outcome") == outcome).alias(outcome)
    got = found.agg(n("loose"), n("packed"), n("failed"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("asked"))
    both = discovered.agg(F.count(F.lit(1)).alias("discovered")).crossJoin(got)  # of one row each
    return both.select("discovered", (F.col("discovered") - F.col("asked")).alias("skipped"), "loose", "packed", F.lit(packs).cast("long").alias("packs"), "failed", "bytes")


def by_repository(stored: DataFrame) -> DataFrame:
    """Objects and bytes of each repository of a table of several."""
    return stored.groupBy("repository").agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
