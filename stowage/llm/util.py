"""Shared pieces of the training-data operators: exact distributed ranks, words, batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Java regex of the separators of words: space and the ASCII controls 09 to 0D.
SPACE = r"[\x20\x09-\x0D]+"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that what is made of them stays small."""
    return (b.slice(at, rows) for b in batches for at in range(0, max(b.num_rows, 1), rows))


def words(text):
    """Array of the words of a text column; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def group_key(column):
    """A string that is never null and differs for null and any value, so that joins need no null-safe test."""
    return F.when(column.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), column.cast("string")))


def offsets(counts: DataFrame, group: list[str], bucket: str, n: str) -> DataFrame:
    """counts (group, bucket, n) with `__before`: the sum of n over the group's smaller buckets."""
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__before", F.coalesce(F.sum(n).over(w), F.lit(0).cast("long")))


def ranked(df: DataFrame, group: str, order: list[str], buckets: int, seed: int = 0) -> DataFrame:
    """Add `__rank` (long, gapless from 0 in each group) and `__group_rows`.

    Rows are ordered by a seeded hash of `order`. Its first bits deal a group to `buckets` windows, or as many as
    there are shuffle partitions if these are more, so that a hot group spreads as far as the cluster does; ranks
    don't depend on their number. The windows' starts come from counts, groups x buckets rows. Equal rows get the
    ranks of their group in any order, which no result can tell apart. `group` must not be null.
    """
    hashed = F.xxhash64(F.lit(seed), *order)
    bits = (max(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) - 1).bit_length()
    df = df.withColumn("__h", hashed).withColumn("__b", F.shiftright("__h", 64 - max(bits, 1)))
    counts = df.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    starts = offsets(counts, [group], "__b", "__n")
    starts = starts.withColumn("__group_rows", F.sum("__n").over(Window.partitionBy(group))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(group, "__b").orderBy("__h", *order)).cast("long") - 1
    df = df.withColumn("__i", inside).join(starts, [group, "__b"])
    return df.withColumn("__rank", F.col("__before") + F.col("__i")).drop("__i", "__h", "__b", "__before")


def with_prefix_sums(df: DataFrame, lengths: str, out: str, block: int = 256) -> DataFrame:
    """Add `out`: for each element of the long array column `lengths` the sum of the elements before it.

    In blocks: n * block / 2 steps. What lambdas look up are columns, as an expression would be worked out anew
    for each element.
    """
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / block).cast("int") - 1, F.lit(0))), lambda b: F.aggregate(F.slice(lengths, b * block + 1, F.lit(block)), zero, add))
    df = df.withColumn("__sums", blocks)
    df = df.withColumn("__starts", F.transform("__sums", lambda x, b: F.aggregate(F.slice("__sums", F.lit(1), b), zero, add)))
    each = F.transform(lengths, lambda x, i: F.get("__starts", F.floor(i / block).cast("int")) + F.aggregate(F.slice(lengths, F.floor(i / block).cast("int") * block + 1, F.pmod(i, F.lit(block))), zero, add))
    return df.withColumn(out, each).drop("__sums", "__starts")


def bitmap(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """Bit key mod bits is set for each key (long) of keys; the driver gathers bits / 64 words at most."""
    word = F.shiftright(F.pmod(key, F.lit(bits)), 6).cast("int")
    words = keys.groupBy(word.alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({key}, {bits}) % 64 as int))")).alias("m")).toArrow()
    out = np.zeros(bits // 64, "int64")
    out[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return out.view("uint64")


def has_bit(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether bitmap() set the bits of the keys; bits is a power of two."""
    at = keys.view("uint64") & np.uint64(64 * len(words) - 1)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
