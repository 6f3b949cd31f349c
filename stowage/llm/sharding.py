"""Sharding: proportional stratified interleaving.

Rows of each stratum (source) are shuffled by a seeded hash and ranked; row r of n gets the fraction
(r + 1/2) / n. Sorted by fraction all strata are spread evenly, so that any cut into runs of equal length holds
each stratum in proportion. Shard sizes differ by one row at most.

A null stratum is a stratum of its own; null ids and repeated rows are rows like any other; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.util import group_key, offsets, ranked
from stowage.session import materialise


def interleave(rows: DataFrame, stratum: str = "source", order: tuple[str, ...] = ("doc_id",), shards: int = 16, seed: int = 42, rank_buckets: int = 64, position_buckets: int = 4096) -> DataFrame:
    """Add shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard) to rows.

    `order` names columns that tell rows apart; rows that agree in them are placed in any order. Give rows without
    their texts where these are not needed: rows are shuffled twice. Neither a hot stratum nor the final order
    goes through one task: ranks and positions are counted in at least `rank_buckets` parts a stratum and
    `position_buckets` parts of the fractions, which are equally full by construction.
    """
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    keyed = rows.select(*names, group_key(F.col(stratum)).alias("__s"))
    keyed = ranked(keyed, "__s", list(order), rank_buckets, seed)
    fraction = (F.col("__rank") + F.lit(0.5)) / F.col("__group_rows")
    placed = keyed.withColumn("__f", fraction).withColumn("__p", F.least(F.floor(F.col("__f") * position_buckets), F.lit(position_buckets - 1)).cast("int"))
    placed = materialise(placed.select(*names, "__s", "__f", "__p"))
    # one row for each part: the only window without a key, over position_buckets rows at most
    starts = offsets(placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__one", F.lit(1)), ["__one"], "__p", "__n")
    starts = starts.select("__p", "__before", F.sum("__n").over(Window.partitionBy("__one")).alias("__rows"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy("__f", "__s", *order)).cast("long") - 1
    out = placed.withColumn("__i", inside).join(starts, "__p").withColumn("__at", F.col("__before") + F.col("__i"))
    out = out.withColumn("shard", F.floor(F.col("__at") * shards / F.col("__rows")).cast("int"))
    # in whole numbers, as the division above rounds: the shard whose first row is the last not after this one
    first = lambda k: F.expr(f"(({k}) * __rows + {shards - 1}) div {shards}")
    out = out.withColumn("shard", F.when(first("shard") > F.col("__at"), F.col("shard") - 1).when(first("shard + 1") <= F.col("__at"), F.col("shard") + 1).otherwise(F.col("shard")))
    return out.select(*names, F.col("shard"), (F.col("__at") - first("shard")).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write whole rows of docs into folders shard=K, each in order of slot; ids must be unique here."""
    whole = docs.join(placed.select(id_col, "shard", "slot"), id_col)
    whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
