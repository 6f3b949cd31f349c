"""Whole pipelines, composed of operators. They plan; sinks act."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage import functions as fn
from stowage import model
from stowage.operators import aggregates, joins, marking, windows
from stowage.session import materialise


@dataclass
class Sweep:
    candidates: DataFrame
    protected: DataFrame
    to_delete: DataFrame


def single_pass(stored: DataFrame, reachable: DataFrame, match: list[str] = joins.HASH_SUFFIX) -> DataFrame:
    """What a sweep would delete, by hash and suffix."""
    return joins.unreachable(stored, aggregates.distinct_entries(reachable, match), match)


def two_pass(stored: DataFrame, reachable: DataFrame, delta: DataFrame | Callable[[], DataFrame], match: list[str] = joins.HASH_SUFFIX) -> Sweep:
    """Candidates are written before the delta is asked for, so that nothing stored meanwhile becomes one.

    match: IN_REPOSITORY for tables of several repositories.
    """
    candidates = materialise(single_pass(stored, reachable, match))
    late = delta() if callable(delta) else delta
    to_delete, protected = joins.protect(candidates, aggregates.distinct_entries(late, match), match)
    return Sweep(candidates, protected, to_delete)


def collect_garbage(stored: DataFrame, roots: DataFrame, edges: DataFrame, refs: DataFrame, again: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], catalogs: DataFrame | None = None) -> Sweep:
    """Mark from all roots, find candidates, then mark what is new since. again: roots, edges and refs as they are by then."""
    visited = marking.mark(roots, edges, catalogs)

    def delta() -> DataFrame:
        new_roots, new_edges, new_refs = again()
        fresh = marking.mark(new_roots, new_edges, seen=visited)
        return marking.emitted(fresh, new_roots, new_edges, new_refs, seen=visited)

    return two_pass(stored, marking.emitted(visited, roots, edges, refs), delta)


@dataclass
class Compaction:
    layout: DataFrame  # prefix, pack_no, hash, new_offset, length, pack_id, offset: what goes where, and whence
    stale: DataFrame  # pack_id: packs of which something moves or goes
    loose: DataFrame  # judged loose objects


def compaction(entries: DataFrame, reachable: DataFrame, loose: DataFrame | None = None, per_pack: int = model.PACK_ENTRIES) -> Compaction:
    """Packs anew with what is reachable, one copy each. A prefix whose packs would come out as they are is left alone."""
    kept = materialise(joins.compacted(entries, reachable))
    return _repacked(entries, kept, per_pack, joins.loose_reachability(loose, reachable) if loose is not None else None)


def merging(entries: DataFrame, above: int = model.MERGE_ABOVE, per_pack: int = model.PACK_ENTRIES) -> Compaction:
    """One copy of everything in the prefixes that have more than `above` packs."""
    some = entries.join(aggregates.fragmented(entries, above).select("prefix"), "prefix", "left_semi")
    return _repacked(some, joins.pack_copies(some).where("copy = 1").drop("copy"), per_pack, None)


def _repacked(entries: DataFrame, kept: DataFrame, per_pack: int, loose: DataFrame | None) -> Compaction:
    layout = windows.pack_layout(kept, per_pack).withColumnRenamed("offset", "new_offset")
    layout = materialise(layout.join(kept.select("hash", "pack_id", "offset"), "hash"))
    # a pack stays if all its entries keep their offsets in one new pack that takes from no other
    by_new = layout.groupBy("prefix", "pack_no").agg(F.min("pack_id").alias("pack_id"), F.max("pack_id").alias("__y"), F.count_if(F.col("offset") != F.col("new_offset")).alias("__m"), F.count(F.lit(1)).alias("n"))
    had = entries.groupBy("pack_id").agg(F.count(F.lit(1)).alias("had"))
    same = by_new.where((F.col("pack_id") == F.col("__y")) & (F.col("__m") == 0)).join(had, "pack_id").where("n = had").select("prefix", "pack_no", "pack_id")
    moved = layout.join(same.select("prefix", "pack_no"), ["prefix", "pack_no"], "left_anti")
    stale = entries.select("pack_id", "prefix").distinct().join(same.select("pack_id"), "pack_id", "left_anti")
    return Compaction(moved, stale, loose)


def fetch_plan(reachable: DataFrame, loose: DataFrame, entries: DataFrame) -> DataFrame:
    return joins.to_fetch(aggregates.distinct_entries(reachable), loose, entries)


def summary(stored: DataFrame, sweep: Sweep) -> DataFrame:
    """Per suffix: objects checked and to be deleted, their bytes and percentage, and what the delta protects."""
    checked = stored.groupBy("suffix").agg(F.count(F.lit(1)).alias("checked"))
    gone = sweep.to_delete.groupBy("suffix").agg(F.count(F.lit(1)).alias("deleted"), F.sum("length").alias("bytes"))
    safe = sweep.protected.groupBy("suffix").agg(F.count(F.lit(1)).alias("protected"))
    out = checked.join(gone, "suffix", "left").join(safe, "suffix", "left").na.fill(0, ["deleted", "bytes", "protected"])
    return out.select("suffix", fn.suffix_label(F.col("suffix")).alias("label"), "checked", "protected", "deleted", "bytes", F.round(fn.percentage(F.col("deleted"), F.col("checked")), 4).alias("percent"))


def report(stored: DataFrame, bag: DataFrame, sweep: Sweep, visited: DataFrame, trees: int = 1, errors: int = 0, phases: dict[str, float] | None = None) -> DataFrame:
    """One row: trees and catalogs marked, entries named, unique and twice, prefixes with objects, then what the sweep checked,
    retained, found, protected and would delete, with bytes and percentage; errors; and seconds of each phase (see sinks.timed)."""
    one = lambda df, *cols: df.agg(*cols)
    n = F.count(F.lit(1))
    parts = [
        one(visited, n.alias("catalogs")),
        aggregates.duplicates(bag),
        aggregates.used_prefixes(stored),
        one(stored, n.alias("checked")),
        one(sweep.candidates, n.alias("candidates")),
        one(sweep.protected, n.alias("protected")),
        one(sweep.to_delete, n.alias("deleted"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # of one row each
    out = out.withColumn("retained", F.col("checked") - F.col("candidates")).withColumn("percent", F.round(fn.percentage(F.col("deleted"), F.col("checked")), 4))
    names = ["catalogs", "entries", "unique_entries", "duplicate_entries", "prefixes", "checked", "retained", "candidates", "protected", "deleted", "percent", "bytes"]
    seconds = [F.lit(float(v)).alias(f"seconds_{k}") for k, v in (phases or {}).items()]
    return out.select(F.lit(trees).cast("long").alias("trees"), *names, fn.human_bytes(F.col("bytes")).alias("freed"), F.lit(errors).cast("long").alias("errors"), *seconds)


@dataclass
class Cycle:
    visited: DataFrame  # hash, depth
    reachable: DataFrame  # hash, suffix
    compaction: Compaction
    stats: DataFrame  # one row


def server_cycle(roots: DataFrame, read: Callable[[DataFrame], DataFrame], entries: DataFrame, loose: DataFrame, extras: DataFrame | None = None, per_pack: int = model.PACK_ENTRIES) -> Cycle:
    """Mark from all roots, then packs anew with what is reachable and loose objects judged by it. sinks.apply_cycle() acts on it.

    read: frontier (hash) to catalog_hash, kind, hash and suffix, such as sources.catalog_refs() of their files; each
    catalog is read once. extras: entries that the manifest keeps alive. Loose objects (name, length) go by hash alone.
    """
    visited, named = marking.mark_reading(roots, read)
    bag = marking.named_entries(visited, roots, named)
    bag = bag.unionByName(extras.select("hash", "suffix")) if extras is not None else bag
    reachable = materialise(aggregates.distinct_entries(bag))
    plan = compaction(entries, reachable, loose, per_pack)
    n = F.count(F.lit(1))
    packed = aggregates.compaction_stats(entries, reachable)
    packed = packed.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("packs", "kept", "removed", "reclaimed")))
    judged = aggregates.loose_stats(plan.loose).select(F.col("kept").alias("loose_kept"), F.col("deleted").alias("loose_deleted"), "bytes_freed")
    stats = visited.agg(n.alias("catalogs")).crossJoin(bag.agg(n.alias("entries"))).crossJoin(reachable.agg(n.alias("unique_entries")))
    return Cycle(visited, reachable, plan, stats.crossJoin(packed).crossJoin(judged))
