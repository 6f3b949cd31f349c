"""Incremental runs: mirror what is new, and remember it only if nothing failed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stowage import functions as fn
from stowage import model, plans, sinks, sources
from stowage.operators import aggregates, marking
from stowage.session import materialise

Fetch = Callable[[str, str], bytes | None]


def fetched(wanted: DataFrame, fetch: Fetch, tasks: int = 10, threshold: int = model.LOOSE_BYTES) -> DataFrame:
    """wanted (hash, suffix) with content, length and outcome (loose, packed or failed). At most `tasks` fetch at once."""

    def get(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for hash_, suffix in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    content = fetch(hash_, suffix)
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([hash_]), pa.array([suffix]), pa.array([content], pa.binary())], ["hash", "suffix", "content"])

    rows = wanted.select("hash", "suffix").repartition(tasks).mapInArrow(get, "hash string, suffix string, content binary")
    length = F.octet_length("content").cast("long")
    return rows.withColumn("length", length).withColumn("outcome", F.when(length.isNull(), "failed").otherwise(fn.size_class(length, threshold)))


def mirror(spark: SparkSession, roots: DataFrame, children: Callable[[DataFrame], DataFrame], refs: Callable[[DataFrame], DataFrame], fetch: Fetch, loose: DataFrame, entries: DataFrame, data_dir: str, packs_dir: str, state: str | None, per_pack: int = model.PACK_ENTRIES, tasks: int = 10, threshold: int = model.LOOSE_BYTES) -> dict[str, int]:
    """One run: walk new catalogs, fetch what is missing, write it loose or into packs by its size, and advance the state only if nothing failed.

    children and refs give, of catalogs (hash), nested ones (hash) and named entries (hash, suffix). Without a state
    those catalogs count as processed whose file is in loose. Returns the counts of aggregates.mirror_stats(), of
    catalogs and of those that failed.
    """
    processed = sources.processed_catalogs(spark, state) if state else loose.where("suffix = 'C'").select("hash")
    processed = materialise(processed)

    def catalogs(frontier: DataFrame) -> DataFrame:
        got = materialise(fetched(frontier.withColumn("suffix", F.lit("C")), fetch, tasks))
        sinks.write_loose(got.where("content is not null"), data_dir)
        return got.select("hash", (F.col("outcome") != "failed").alias("ok"))

    visited, lost = marking.mark_fetching(roots, children, processed, catalogs)
    named = materialise(aggregates.distinct_entries(refs(visited.join(lost, "hash", "left_anti").select("hash"))))
    got = materialise(fetched(plans.fetch_plan(named, loose, entries), fetch, tasks, threshold))
    packs = sinks.write_objects(got.where("content is not null"), data_dir, packs_dir, per_pack)
    counts = aggregates.mirror_stats(named, got, len(packs)).first().asDict()
    out = {"catalogs": visited.count(), "catalogs_failed": lost.count(), **counts}
    if state and not out["catalogs_failed"] and not out["failed"]:
        sinks.save_processed(processed.select("hash").unionAll(visited.select("hash")), state)
    return out


def watch(spark: SparkSession, manifests: str, checkpoint: str, cycle: Callable[[dict, int], object], once: bool = True, every: str = "15 minutes", name: str | None = None) -> StreamingQuery:
    """Run cycle(manifest, batch) for each manifest that comes into a folder; with once, for those that are there, else every so often.

    The checkpoint advances when a cycle has ended well; a failed one comes again.
    """
    texts = spark.readStream.format("text").option("wholetext", "true").load(manifests).select(F.lit(manifests).alias("path"), F.col("value").alias("text"))

    def batch(df: DataFrame, batch_id: int) -> None:
        for row in sources.parse_manifests(df).toLocalIterator():
            if row["root"] and row["collectable"]:
                cycle(row.asDict(), batch_id)

    writer = texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def fresh_objects(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of (hash, suffix, ts) without what came within `late` before."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["hash", "suffix"])
