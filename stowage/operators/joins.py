"""Anti, semi and lookup joins between stored, reachable and packed objects.

Two equalities of objects exist and are never mixed: HASH_SUFFIX tells variants of one hash apart, HASH does not.
Build sides are left to Catalyst, which broadcasts what is small by its statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage import functions as fn

HASH_SUFFIX, HASH = ["hash", "suffix"], ["hash"]
#: Of tables of several repositories, whose stores are apart.
IN_REPOSITORY = ["repository", "hash", "suffix"]


def across(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of those of several repositories, with the repository as its first column."""
    out = None
    for name, df in sorted(tables.items()):
        part = df.select(F.lit(name).alias("repository"), *(c for c in df.columns if c != "repository"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no repository")
    return out


def _keys(df: DataFrame, match: list[str]) -> DataFrame:
    return df.select(*match)


def unreachable(stored: DataFrame, reachable: DataFrame, match: list[str] = HASH_SUFFIX) -> DataFrame:
    """Stored rows that no reachable entry names: the sweep's candidates."""
    return stored.join(_keys(reachable, match), match, "left_anti")


def retained(stored: DataFrame, reachable: DataFrame, match: list[str] = HASH_SUFFIX) -> DataFrame:
    return stored.join(_keys(reachable, match), match, "left_semi")


def protect(candidates: DataFrame, delta: DataFrame, match: list[str] = HASH_SUFFIX) -> tuple[DataFrame, DataFrame]:
    """What stays to be deleted, and what the delta protects."""
    return unreachable(candidates, delta, match), retained(candidates, delta, match)


def pack_copies(entries: DataFrame) -> DataFrame:
    """entries (pack_id, prefix, hash, offset, length) with copy: 1 for the first of its hash in order of pack and offset."""
    return entries.withColumn("copy", F.row_number().over(Window.partitionBy("hash").orderBy("pack_id", "offset")))


def first_copies(entries: DataFrame) -> DataFrame:
    """The first copy of each hash in order of pack and offset, by partial minima."""
    rest = [c for c in entries.columns if c not in ("hash", "pack_id", "offset")]
    one = entries.groupBy("hash").agg(F.min(F.struct("pack_id", "offset", *rest)).alias("s"))
    return one.select(*(F.col("hash") if c == "hash" else F.col(f"s.{c}").alias(c) for c in entries.columns))


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, to be broadcast if it has no more than `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def compacted(entries: DataFrame, reachable: DataFrame) -> DataFrame:
    """One entry of each reachable hash. Both steps are keyed by the hash, so that entries are shuffled once, if at all."""
    return first_copies(retained(entries, reachable, HASH))


def dropped(entries: DataFrame, reachable: DataFrame) -> DataFrame:
    """Entries that compaction leaves out, with why: a second copy, or unreachable."""
    marked = pack_copies(entries)
    return marked.where("copy > 1").drop("copy").withColumn("why", F.lit("copy")).unionByName(unreachable(marked.where("copy = 1").drop("copy"), reachable, HASH).withColumn("why", F.lit("unreachable")))


def content_refs(catalog: DataFrame) -> DataFrame:
    """catalog_hash, hash, suffix of the catalog rows that name content of their own."""
    own = catalog.where(fn.is_named(F.col("hash")) & ~fn.is_external(F.col("flags")))
    return own.select("catalog_hash", F.lower(F.hex("hash")).alias("hash"), fn.content_suffix(F.col("flags")).alias("suffix"))


def chunk_refs(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """catalog_hash, hash, suffix P of the chunks of files that aren't external; one catalog is one scope."""
    files = catalog.where(~fn.is_external(F.col("flags"))).select("catalog_hash", "md5path_1", "md5path_2")
    own = chunks.where(fn.is_named(F.col("hash"))).join(files, ["catalog_hash", "md5path_1", "md5path_2"])
    return own.select("catalog_hash", F.lower(F.hex("hash")).alias("hash"), F.lit("P").alias("suffix"))


def nested_edges(nested: DataFrame) -> DataFrame:
    return nested.where(F.length("sha1") > 0).select(F.col("catalog_hash").alias("parent"), F.lower("sha1").alias("child"))


def loose_reachability(names: DataFrame, reachable: DataFrame) -> DataFrame:
    """names (name, length) whose first 40 characters are hex, with kept; others are skipped, not judged."""
    known = names.withColumn("hash", F.lower(fn.hash_of_name(F.col("name")))).where(F.col("hash").isNotNull())
    marks = reachable.select("hash").distinct().withColumn("kept", F.lit(True))
    return known.join(marks, "hash", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def to_fetch(reachable: DataFrame, loose: DataFrame, packs: DataFrame) -> DataFrame:
    """Reachable entries that are neither loose (by hash and suffix) nor packed (by hash)."""
    return unreachable(unreachable(reachable, loose, HASH_SUFFIX), packs, HASH)


def other_roots(tags: DataFrame, current: str) -> DataFrame:
    return tags.where(F.col("hash") != current)


def lookup(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """wanted (hash) with the pack, offset and length of its first copy. Only entries of wanted hashes are ranked."""
    found = entries.join(few(wanted.select("hash").distinct()), "hash", "left_semi").select("hash", "pack_id", "offset", "length")
    return wanted.join(first_copies(found), "hash")


def resolve(wanted: DataFrame, loose: DataFrame, entries: DataFrame, upstream: DataFrame | None = None) -> DataFrame:
    """wanted (hash, suffix) with where: loose, pack, upstream or missing, the first that has it."""
    asked = few(wanted.select("hash").distinct())
    found = wanted.join(loose.select("hash", "suffix").join(asked, "hash", "left_semi").distinct().withColumn("l", F.lit(1)), HASH_SUFFIX, "left")
    packed = entries.join(asked, "hash", "left_semi").select("hash", "pack_id", "offset", "length")
    found = found.join(first_copies(packed), "hash", "left")
    place = F.when(F.col("l") == 1, "loose").when(F.col("pack_id").isNotNull(), "pack")
    if upstream is not None:
        found = found.join(upstream.select("hash").join(asked, "hash", "left_semi").distinct().withColumn("u", F.lit(1)), "hash", "left")
        place = place.when(F.col("u") == 1, "upstream")
    of_pack = lambda c: F.when(F.col("l").isNull(), F.col(c)).alias(c)
    return found.select("hash", "suffix", place.otherwise("missing").alias("place"), of_pack("pack_id"), of_pack("offset"), of_pack("length"))
