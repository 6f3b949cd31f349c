"""Queries that write real files (catalogs, histories, chunks, packs, loose objects, states) of the driver's tables and read them back.

Each works in a folder of its own below the shared folder, which driver and executors must see as a file system; it
is removed once the result is written.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage import functions as fn
from stowage import plans, sinks, sources, streaming
from stowage import queries as q
from stowage.operators import aggregates, joins, marking, windows
from stowage.session import materialise, shared_dir

#: Keys of orders that one catalog holds.
BLOCK = 1024
# The tables of a catalog and of a history, as the file formats have them.
CATALOG_DDL = """
CREATE TABLE properties (key TEXT, value TEXT);
CREATE TABLE catalog (md5path_1 INTEGER, md5path_2 INTEGER, parent_1 INTEGER, parent_2 INTEGER, hardlinks INTEGER, hash BLOB, size INTEGER, mode INTEGER, mtime INTEGER, flags INTEGER, name TEXT, symlink TEXT, uid INTEGER, gid INTEGER, xattr BLOB);
CREATE TABLE chunks (md5path_1 INTEGER, md5path_2 INTEGER, offset INTEGER, size INTEGER, hash BLOB);
CREATE TABLE nested_catalogs (path TEXT, sha1 TEXT, size INTEGER);
"""
HISTORY_DDL = "CREATE TABLE tags (name TEXT, hash TEXT, revision INTEGER)"


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """A folder that all see and that goes in the end."""
    base = shared_dir(spark)
    if "://" in base and not base.startswith("file://"):
        raise ValueError(f"{base} is no folder of a file system")
    path = os.path.join(base.removeprefix("file://").removeprefix("file:"), f"files-{uuid.uuid4().hex}")
    os.makedirs(path)
    try:
        yield path
    finally:
        shutil.rmtree(path, ignore_errors=True)


def in_workspace(query: Callable[[SparkSession, str, str], DataFrame]) -> q.Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        with workspace(s) as path:
            return materialise(query(s, d, path))

    return run


def order_catalogs(s: SparkSession, d: str) -> DataFrame:
    """hash, suffix and content of a catalog for each block of orders; the catalog of block k nests those of 2k + 1 and 2k + 2."""
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    orders = q.table(s, d, "orders").select(block("o_orderkey").alias("k"), F.lit(0).alias("kind"), F.col("o_orderkey").alias("a"), F.lit(0).cast("long").alias("b"), F.col("o_orderstatus").alias("c"))
    lines = q.table(s, d, "lineitem").select(block("l_orderkey"), F.lit(1), "l_orderkey", F.col("l_linenumber").cast("long"), F.lit(""))
    blocks = orders.select("k").distinct()
    nested = blocks.where("k > 0").select(F.floor((F.col("k") - 1) / 2).cast("long"), F.lit(2), "k", F.lit(0).cast("long"), F.lit(""))

    def build(pdf):
        import hashlib

        import pandas as pd

        sha = lambda x: hashlib.sha1(x.encode()).digest()
        db, k = sqlite3.connect(":memory:"), int(pdf["k"].iloc[0])
        db.executescript(CATALOG_DDL)
        db.execute("INSERT INTO properties VALUES ('schema', '2.5')")
        flags = {"F": 132, "O": 68, "P": 1}
        for kind, a, b, c in sorted(zip(pdf["kind"], pdf["a"], pdf["b"], pdf["c"].fillna(""), strict=True)):
            if kind == 0:
                db.execute("INSERT INTO catalog (md5path_1, md5path_2, hash, flags, name) VALUES (?, 0, ?, ?, ?)", (int(a), sha(str(a)), flags.get(c, 4), f"order {a}"))
            elif kind == 1:
                db.execute("INSERT INTO chunks VALUES (?, 0, ?, 1, ?)", (int(a), int(b), sha(f"{a}-{b}")))
            else:
                db.execute("INSERT INTO nested_catalogs VALUES (?, ?, 1)", (f"/{a}", sha(f"c{a}").hex()))
        db.commit()
        data = db.serialize()
        return pd.DataFrame({"hash": [sha(f"c{k}").hex()], "suffix": ["C"], "content": [zlib.compress(data) if k % 2 else data]})

    return orders.unionAll(lines).unionAll(nested).groupBy("k").applyInPandas(build, "hash string, suffix string, content binary")


def marked_catalogs(s: SparkSession, d: str, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roots, visited catalogs and what they name, all read from catalog files."""
    sinks.write_loose(order_catalogs(s, d), path)
    roots = s.range(1).select(F.sha1(F.lit("c0").cast("binary")).alias("hash"))
    read = sources.file_reader(path)
    return (roots, *marking.mark_reading(roots, lambda f: sources.catalog_refs(sources.catalog_files(f, read))))


def catalog_scan(s: SparkSession, d: str, path: str) -> DataFrame:
    _, _, named = marked_catalogs(s, d, path)
    return named.groupBy("catalog_hash", "kind", "hash", "suffix").agg(F.count(F.lit(1)).alias("n"))


def catalog_walk(s: SparkSession, d: str, path: str) -> DataFrame:
    return marked_catalogs(s, d, path)[1].select("hash", "depth")


def catalog_counts(s: SparkSession, d: str, path: str) -> DataFrame:
    roots, visited, named = marked_catalogs(s, d, path)
    edges = named.where("kind = 'nested'").select(F.col("catalog_hash").alias("parent"), F.col("hash").alias("child"))
    return marking.counts(roots, visited, edges, named.where("kind != 'nested'"))


def history_scan(s: SparkSession, d: str, path: str) -> DataFrame:
    def build(pdf):
        import pandas as pd

        db = sqlite3.connect(":memory:")
        db.execute(HISTORY_DDL)
        db.executemany("INSERT INTO tags VALUES (?, ?, ?)", [(n, h if isinstance(h, str) else None, int(r)) for n, h, r in zip(pdf["name"], pdf["hash"], pdf["revision"], strict=True)])
        db.commit()
        return pd.DataFrame({"hash": ["h"], "content": [zlib.compress(db.serialize())]})

    files = q.tags(s, d).withColumn("k", F.floor(F.col("name").cast("long") / BLOCK)).groupBy("k").applyInPandas(build, "hash string, content binary")
    return windows.tagged_roots(sources.history_tags(files))


def entries(s: SparkSession, d: str) -> DataFrame:
    return q.stored(s, d).select("hash", "suffix", "prefix")


def chunk_files(s: SparkSession, d: str, path: str) -> DataFrame:
    written = s.createDataFrame([(p,) for p in sinks.write_chunks(entries(s, d), path)], "path string")  # 256 at most
    read = sources.read_chunks(s, path).withColumn("prefix", fn.prefix(F.col("hash")))
    return read.join(written.select(sources.chunk_prefix(F.col("path")).alias("prefix")), "prefix")


def contents(s: SparkSession, d: str) -> DataFrame:
    """hash, suffix and content of the stored documents, once each."""
    docs = q.stored(s, d).select("doc_id", "hash", "suffix").join(q.table(s, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content")), "doc_id")
    return docs.dropDuplicates(["hash", "suffix"]).select("hash", "suffix", "content")


def write_document_packs(s: SparkSession, d: str, path: str, some: str = "true") -> list[dict]:
    objects = contents(s, d).where(some).withColumn("length", F.octet_length("content").cast("long")).withColumn("outcome", F.lit("packed"))
    return sinks.write_objects(objects, path, path, q.PER_PACK)


def pack_files(s: SparkSession, d: str, path: str) -> DataFrame:
    write_document_packs(s, d, path)
    read = sources.read_objects(sources.pack_entries(s, path), path)
    return read.select("prefix", "hash", "offset", "length", (F.sha1("content") == F.col("hash")).alias("intact"))


def pack_refresh(s: SparkSession, d: str, path: str) -> DataFrame:
    """Packs of one half of the prefixes, then of the other."""
    store = sources.PackStore(s, path)
    write_document_packs(s, d, path, "hash < '8'")
    first = store.refresh()
    write_document_packs(s, d, path, "hash >= '8'")
    second = store.refresh()
    return store.entries().agg(F.count(F.lit(1)).alias("objects")).select(F.lit(first["added"]).cast("long").alias("first_added"), F.lit(second["kept"]).cast("long").alias("kept"), F.lit(second["added"]).cast("long").alias("added"), F.lit(second["corrupt"]).cast("long").alias("corrupt"), "objects")


def loose_files(s: SparkSession, d: str, path: str) -> DataFrame:
    sinks.write_loose(contents(s, d), path)
    return sources.loose_objects(s, path).select("hash", "suffix", "prefix", "length")


def unreachable_list(s: SparkSession, d: str, path: str) -> DataFrame:
    sinks.write_list(plans.single_pass(q.stored(s, d), q.reachable(s, d)), f"{path}/list")
    return s.read.text(f"{path}/list")


def deleted_files(s: SparkSession, d: str, path: str) -> DataFrame:
    """Outcomes of a sweep of loose files, and what is left."""
    sinks.write_loose(contents(s, d), path)
    gone = plans.single_pass(sources.loose_objects(s, path), q.reachable(s, d))
    done = sinks.delete_files(gone, really=True)
    again = sinks.delete_files(done.select("path", "length", "suffix"), really=True)
    left = sources.loose_objects(s, path).select("suffix", F.lit("left").alias("outcome"))
    out = done.select("suffix", "outcome").unionAll(again.select("suffix", "outcome")).unionAll(left)
    return out.groupBy("suffix", "outcome").agg(F.count(F.lit(1)).alias("n"))


def processed_state(s: SparkSession, d: str, path: str) -> DataFrame:
    """A state that was saved twice, the second time with more."""
    first = q.reachable(s, d).select("hash")
    sinks.save_processed(first, f"{path}/state")
    sinks.save_processed(sources.processed_catalogs(s, f"{path}/state").unionAll(q.delta(s, d).select("hash")), f"{path}/state")
    return sources.processed_catalogs(s, f"{path}/state")


def status_file(s: SparkSession, d: str, path: str) -> DataFrame:
    total = q.stored(s, d).agg(F.count(F.lit(1)).alias("objects"), F.sum("length").alias("bytes")).first()
    last = q.table(s, d, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("t")).select(fn.rfc3339(F.col("t")).alias("t")).first()["t"]
    sinks.write_status(f"{path}/status.json", objects=total["objects"], last_gc="never")
    sinks.write_status(f"{path}/status.json", bytes=total["bytes"], last_gc=last)
    text = s.read.text(f"{path}/status.json", wholetext=True)
    return text.select(F.from_json("value", "objects long, bytes long, last_gc string").alias("j")).select("j.*")


def mirror_run(s: SparkSession, d: str, path: str) -> DataFrame:
    """Good documents are named upstream, where those whose length ends in 0 are missing; bad ones are here already."""
    has = contents(s, d).where(F.octet_length("content") % 10 != 0)
    root = s.range(1).select(F.sha1(F.lit("root").cast("binary")).alias("hash"))
    sinks.write_loose(has.unionAll(root.select("hash", F.lit("C"), F.lit("catalog").cast("binary"))), f"{path}/upstream")
    read, refs = sources.file_reader(f"{path}/upstream"), materialise(q.reachable(s, d))
    here = materialise(q.delta(s, d))
    nothing = s.createDataFrame([], "pack_id string, prefix string, hash string, offset long, length long")
    out = streaming.mirror(s, root, lambda f: f.limit(0), lambda f: refs.join(F.broadcast(f.select(F.lit(1).alias("__one")).limit(1)), F.lit(True), "left_semi"), read, here, nothing, f"{path}/data", f"{path}/packs", f"{path}/state", per_pack=q.PER_PACK, threshold=q.LOOSE)
    there = sources.pack_entries(s, f"{path}/packs").agg(F.countDistinct("hash").alias("in_packs")).crossJoin(sources.loose_objects(s, f"{path}/data").where("suffix != 'C' or length > 7").agg(F.count(F.lit(1)).alias("in_files")))
    return there.select(*(F.lit(v).cast("long").alias(k) for k, v in out.items()), "in_packs", "in_files")


def fresh_stream(s: SparkSession, d: str, path: str) -> DataFrame:
    """Events as a stream of objects, without what came before."""
    q.table(s, d, "events").write.parquet(f"{path}/in")
    events = s.readStream.schema(s.read.parquet(f"{path}/in").schema).parquet(f"{path}/in").select(F.col("user_id").cast("string").alias("hash"), F.col("event_type").alias("suffix"), F.col("ts").cast("timestamp").alias("ts"))
    fresh = streaming.fresh_objects(events, late="36500 days").select("hash", "suffix")
    fresh.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema("hash string, suffix string").parquet(f"{path}/out")


def document_catalogs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges and named entries of a root, a catalog for each suffix, and the good documents below."""
    good = q.labelled(s, d, 1).withColumn("own", F.concat(F.lit("catalog "), "suffix"))
    edges = good.select(F.lit("root").alias("parent"), F.col("own").alias("child")).distinct()
    return edges, good.select(F.col("own").alias("catalog_hash"), "hash", "suffix")


def server_cycle(s: SparkSession, d: str) -> DataFrame:
    edges, refs = document_catalogs(s, d)
    named = materialise(edges.select(F.col("parent").alias("catalog_hash"), F.lit("nested").alias("kind"), F.col("child").alias("hash"), F.lit("C").alias("suffix")).unionByName(refs.withColumn("kind", F.lit("content"))))
    roots = s.range(1).select(F.lit("root").alias("hash"))
    read = lambda f: named.join(f.withColumnRenamed("hash", "catalog_hash"), "catalog_hash", "left_semi")
    extras = s.sql("SELECT 'history' AS hash, 'H' AS suffix")
    return plans.server_cycle(roots, read, q.packs(s, d), q.loose_names(s, d), extras, q.PER_PACK).stats


def gc_cycle(s: SparkSession, d: str) -> DataFrame:
    """Both passes from the roots on: good documents are named at first, bad ones by a catalog that is new by then."""
    edges, refs = document_catalogs(s, d)
    roots = s.range(1).select(F.lit("root").alias("hash"))
    late = s.range(1).select(F.lit("late").alias("hash"))
    more = q.delta(s, d).select(F.lit("late").alias("catalog_hash"), "hash", "suffix")
    again = lambda: (roots.unionAll(late), edges, refs.unionByName(more))
    objects = q.stored(s, d)
    sweep = plans.collect_garbage(objects, roots, edges, refs, again)
    return plans.summary(objects, sweep)


def gc_report(s: SparkSession, d: str) -> DataFrame:
    edges, refs = document_catalogs(s, d)
    roots = s.range(1).select(F.lit("root").alias("hash"))
    visited, objects = marking.mark(roots, edges), q.stored(s, d)
    bag = marking.emitted(visited, roots, edges, refs)
    return plans.report(objects, bag, plans.two_pass(objects, bag, q.delta(s, d)), visited)


def merge_plan(s: SparkSession, d: str) -> DataFrame:
    return plans.merging(q.packs(s, d), 3, q.PER_PACK).layout.select("prefix", "pack_no", "hash", "new_offset", "length", "pack_id", "offset")


def repository_sweep(s: SparkSession, d: str) -> DataFrame:
    """Documents of a language are a repository; the same text may be reachable in one and not in another."""
    docs = q.table(s, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("repository"))
    objects = q.stored(s, d).join(docs, "doc_id")
    label = lambda k: objects.join(q.table(s, d, "labels").where(F.col("quality") == k).select("doc_id"), "doc_id", "left_semi")
    sweep = plans.two_pass(objects, label(1), label(0), joins.IN_REPOSITORY)
    gone = aggregates.by_repository(sweep.to_delete).withColumnsRenamed({"objects": "deleted", "bytes": "freed"})
    return aggregates.by_repository(objects).join(gone, "repository", "left").na.fill(0, ["deleted", "freed"])


def utc_stamps(s: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return q.table(s, d, "events").select("event_id", fn.rfc3339(ts).alias("iso"), fn.utc_stamp(ts).alias("stamp"))


def url_objects(s: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/repo-"), F.coalesce("suffix", F.lit("")), F.lit(".org/data/"), fn.object_path(F.col("hash"), F.col("suffix")))
    two, name, hash_ = fn.url_object(F.col("path"))
    return q.stored(s, d).select("doc_id", path.alias("path")).select("doc_id", fn.repository_name(F.col("path")).alias("repository"), two.alias("prefix"), name.alias("name"), hash_.alias("hash"))


def binary_entries(s: SparkSession, d: str) -> DataFrame:
    """Records of 21 bytes, read back, and their place in the order of bytes within their prefix."""
    df = entries(s, d).distinct().withColumn("e", fn.to_binary(F.col("hash"), F.col("suffix")))
    place = F.row_number().over(q.Window.partitionBy("prefix").orderBy("e"))
    back, suffix = fn.from_binary(F.col("e"))
    return df.select(F.lower(F.hex("e")).alias("record"), back.alias("hash"), suffix.alias("suffix"), place.alias("place"))


def content_kinds(s: SparkSession, d: str) -> DataFrame:
    """Orders as rows of all kinds: external files, chunked files, directories with a catalog of their own, and rows without a hash."""
    digest = F.when(F.col("o_orderkey") % 10 != 0, F.unhex(F.sha1(F.col("o_orderkey").cast("string").cast("binary"))))
    flags = F.when(F.col("o_orderstatus") == "F", 132).when(F.col("o_orderstatus") == "P", 1).otherwise(68).cast("long")
    catalog = q.table(s, d, "orders").select(F.lit("c").alias("catalog_hash"), digest.alias("hash"), flags.alias("flags"))
    return joins.content_refs(catalog).select("hash", "suffix")


def nested_edges(s: SparkSession, d: str) -> DataFrame:
    nested = q.table(s, d, "nation").select(F.concat(F.lit("R"), "n_regionkey").alias("catalog_hash"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.upper(F.sha1(F.col("n_name").cast("binary")))).alias("sha1"))
    return joins.nested_edges(nested)


def manifest_scan(s: SparkSession, d: str) -> DataFrame:
    """A manifest for each document, with an older root before, two histories, a signature, and what it keeps alive."""
    text = F.concat_ws("\n", F.lit("Cold"), F.concat(F.lit("C"), "hash"), F.concat(F.lit("B"), "length"), F.lit("Hfirst"), F.concat(F.lit("H"), F.reverse("hash"), F.lit("\r")), F.concat(F.lit("S"), "doc_id"), F.when(F.col("doc_id") % 3 == 0, "Gno").when(F.col("doc_id") % 3 == 1, "Gyes"), F.concat(F.lit("Nname "), "suffix"), F.lit("--"), F.lit("Cforged"))
    parsed = sources.parse_manifests(q.stored(s, d).select(F.col("doc_id").cast("string").alias("path"), text.alias("text")))
    alive = sources.manifest_entries(parsed).groupBy("path").agg(F.array_join(F.sort_array(F.collect_list(fn.full_name(F.col("hash"), F.col("suffix")))), " ").alias("alive"))
    return parsed.select("path", "root", "size", "history", "revision", "collectable", "name").join(alive, "path")


QUERIES: dict[str, q.Query] = {f.__name__: in_workspace(f) for f in (catalog_scan, catalog_walk, catalog_counts, history_scan, chunk_files, pack_files, pack_refresh, loose_files, unreachable_list, deleted_files, processed_state, status_file, mirror_run, fresh_stream)}
QUERIES |= {f.__name__: f for f in (server_cycle, gc_cycle, gc_report, merge_plan, repository_sweep, utc_stamps, url_objects, binary_entries, content_kinds, nested_edges, manifest_scan)}

CATALOGS = f"""
blocks AS (SELECT DISTINCT o_orderkey // {BLOCK} AS k FROM orders),
walked AS (
  SELECT k, 0 AS depth FROM blocks WHERE k = 0
  UNION ALL SELECT b.k, depth + 1 FROM walked w JOIN blocks b ON (b.k - 1) // 2 = w.k AND b.k > 0
), files AS (
  SELECT k, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 132 WHEN 'O' THEN 68 WHEN 'P' THEN 1 ELSE 4 END AS flags FROM orders JOIN walked ON o_orderkey // {BLOCK} = k
), named AS (
  SELECT k, 'content' AS kind, sha1(o_orderkey::VARCHAR) AS hash, CASE flags WHEN 1 THEN 'L' ELSE '' END AS suffix FROM files WHERE flags <> 132
  UNION ALL SELECT k, 'chunk', sha1(l_orderkey || '-' || l_linenumber), 'P' FROM lineitem JOIN files ON l_orderkey = o_orderkey AND flags <> 132
  UNION ALL SELECT w.k, 'nested', sha1('c' || b.k), 'C' FROM walked w JOIN blocks b ON (b.k - 1) // 2 = w.k AND b.k > 0
)"""
#: The bag that document_catalogs() names, from its root.
NAMED = """, own AS (SELECT DISTINCT suffix FROM reachable), bag AS (
  SELECT 'root' AS hash, 'C' AS suffix UNION ALL SELECT 'catalog ' || suffix, 'C' FROM own UNION ALL SELECT hash, suffix FROM reachable
)"""
DISTINCT_CONTENT = "SELECT hash, any_value(suffix) AS suffix, substr(hash, 1, 2) AS prefix, min(length) AS length FROM stored GROUP BY hash"
SWEPT = "SELECT *, (hash, suffix) IN (SELECT (hash, suffix) FROM reachable) AS kept FROM (SELECT DISTINCT hash, suffix, length FROM stored)"

ORACLES: dict[str, str] = {
    "catalog_scan": f"WITH RECURSIVE {CATALOGS} SELECT sha1('c' || k) AS catalog_hash, kind, hash, suffix, count(*) AS n FROM named GROUP BY ALL",
    "catalog_walk": f"WITH RECURSIVE {CATALOGS} SELECT sha1('c' || k) AS hash, depth::INT AS depth FROM walked",
    "catalog_counts": f"WITH RECURSIVE {CATALOGS} SELECT (SELECT count(*) FROM walked) AS started, (SELECT count(*) FROM walked) AS processed, 0::BIGINT AS skipped, 1 + count(*) AS emitted FROM named",
    "history_scan": "SELECT event_id::VARCHAR AS name, user_id::VARCHAR AS hash, epoch_us(ts) AS revision FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) = 1",
    "chunk_files": q._repository("SELECT DISTINCT prefix, hash, suffix FROM stored"),
    "pack_files": q._repository(f"""SELECT * EXCLUDE (pack_no), true AS intact FROM ({q._layout("SELECT hash, substr(hash, 1, 2) AS prefix, min(length) AS length FROM stored GROUP BY hash", '"offset"')})"""),
    "pack_refresh": q._repository(f"""
, sizes AS (SELECT prefix, ceil(count(DISTINCT hash) / {q.PER_PACK}::DOUBLE)::BIGINT AS n FROM stored GROUP BY prefix)
SELECT CAST(coalesce(sum(n) FILTER (prefix < '8'), 0) AS BIGINT) AS first_added, CAST(coalesce(sum(n) FILTER (prefix < '8'), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (prefix >= '8'), 0) AS BIGINT) AS added, 0::BIGINT AS corrupt,
       (SELECT count(DISTINCT hash) FROM stored) AS objects FROM sizes"""),
    "loose_files": q._repository("SELECT DISTINCT hash, suffix, prefix, length FROM stored"),
    "unreachable_list": q._repository("SELECT hash || suffix AS value FROM candidates"),
    "deleted_files": q._repository(f"""
, swept AS ({SWEPT}), told AS (SELECT suffix, unnest(CASE WHEN kept THEN ['left'] ELSE ['deleted', 'absent'] END) AS outcome FROM swept)
SELECT suffix, outcome, count(*) AS n FROM told GROUP BY ALL"""),
    "processed_state": q._repository("SELECT hash FROM reachable UNION SELECT hash FROM delta"),
    "status_file": q._repository("SELECT count(*) AS objects, CAST(sum(length) AS BIGINT) AS bytes, (SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') FROM events) AS last_gc FROM stored"),
    "mirror_run": q._repository(f"""
, asked AS (SELECT DISTINCT hash, suffix, length FROM stored s WHERE EXISTS (SELECT 1 FROM reachable r WHERE r.hash = s.hash AND r.suffix = s.suffix)),
absent AS (SELECT * FROM asked a WHERE NOT EXISTS (SELECT 1 FROM delta b WHERE b.hash = a.hash AND b.suffix = a.suffix)),
small AS (SELECT DISTINCT hash FROM absent WHERE length % 10 <> 0 AND length < {q.LOOSE})
SELECT 1::BIGINT AS catalogs, 0::BIGINT AS catalogs_failed, (SELECT count(*) FROM asked) AS discovered, (SELECT count(*) FROM asked) - count(*) AS skipped,
       count(*) FILTER (length % 10 <> 0 AND length >= {q.LOOSE}) AS loose, count(*) FILTER (length % 10 <> 0 AND length < {q.LOOSE}) AS packed,
       (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT ceil(count(*) / {q.PER_PACK}::DOUBLE) AS n FROM small GROUP BY substr(hash, 1, 2))) AS packs,
       count(*) FILTER (length % 10 = 0) AS failed, CAST(coalesce(sum(length) FILTER (length % 10 <> 0), 0) AS BIGINT) AS bytes,
       (SELECT count(*) FROM small) AS in_packs, count(*) FILTER (length % 10 <> 0 AND length >= {q.LOOSE}) AS in_files FROM absent"""),
    "fresh_stream": "SELECT DISTINCT user_id::VARCHAR AS hash, event_type AS suffix FROM events",
    "server_cycle": q._repository(NAMED + """
, all_named AS (SELECT * FROM bag UNION ALL SELECT 'history', 'H'), live AS (SELECT DISTINCT hash, suffix FROM all_named),
packed AS (
  SELECT prefix, count(DISTINCT pack_id) AS packs, count(*) FILTER (copy = 1 AND live) AS kept, count(*) FILTER (copy = 1 AND NOT live) AS removed, greatest(sum(length) - coalesce(sum(length) FILTER (copy = 1 AND live), 0), 0) AS reclaimed
  FROM (SELECT *, hash IN (SELECT hash FROM live) AS live FROM copies) GROUP BY prefix
), judged AS (
  SELECT length, substr(name, 1, 40) IN (SELECT hash FROM live) AS kept FROM (SELECT length, CASE suffix WHEN '' THEN 'zz' || hash ELSE hash || suffix END AS name FROM stored) WHERE regexp_matches(name, '^[0-9a-fA-F]{40}')
)
SELECT 1 + (SELECT count(*) FROM own) AS catalogs, (SELECT count(*) FROM all_named) AS entries, (SELECT count(*) FROM live) AS unique_entries,
       CAST(sum(packs) AS BIGINT) AS packs, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(reclaimed) AS BIGINT) AS reclaimed,
       (SELECT count(*) FROM judged WHERE kept) AS loose_kept, (SELECT count(*) FROM judged WHERE NOT kept) AS loose_deleted, (SELECT CAST(coalesce(sum(length), 0) AS BIGINT) FROM judged WHERE NOT kept) AS bytes_freed FROM packed"""),
    "gc_cycle": q.ORACLES["gc_two_pass"],
    "gc_report": q._repository(NAMED + """
, swept AS (SELECT *, (hash, suffix) NOT IN (SELECT (hash, suffix) FROM bag) AS gone, (hash, suffix) IN (SELECT (hash, suffix) FROM delta) AS safe FROM stored), sums AS (
  SELECT count(*) AS checked, count(*) FILTER (NOT gone) AS retained, count(*) FILTER (gone) AS candidates, count(*) FILTER (gone AND safe) AS protected, count(*) FILTER (gone AND NOT safe) AS deleted,
         round(100.0::DOUBLE * count(*) FILTER (gone AND NOT safe) / count(*), 4) AS percent, CAST(coalesce(sum(length) FILTER (gone AND NOT safe), 0) AS BIGINT) AS bytes FROM swept
)
SELECT 1::BIGINT AS trees, 1 + (SELECT count(*) FROM own) AS catalogs, (SELECT count(*) FROM bag) AS entries, (SELECT count(DISTINCT hash || '-' || suffix) FROM bag) AS unique_entries,
       (SELECT count(*) - count(DISTINCT hash || '-' || suffix) FROM bag) AS duplicate_entries, (SELECT count(DISTINCT prefix) FROM stored) AS prefixes, sums.*,
       CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN printf('%.1f', bytes / 1024.0::DOUBLE) || ' KB' ELSE printf('%.1f', bytes / 1048576.0::DOUBLE) || ' MB' END AS freed, 0::BIGINT AS errors FROM sums"""),
    "merge_plan": q._repository(f"""
, many AS (SELECT prefix FROM packs GROUP BY prefix HAVING count(DISTINCT pack_id) > 3)
SELECT * EXCLUDE (had, n, one, moved) FROM (SELECT *, count(*) OVER p AS n, min(pack_id) OVER p = max(pack_id) OVER p AS one, count(*) FILTER ("offset" <> new_offset) OVER p AS moved
FROM ({q._layout("SELECT pack_id, prefix, hash, " + '"offset"' + ", length FROM copies WHERE copy = 1 AND prefix IN (SELECT prefix FROM many)", "new_offset", ', pack_id, "offset"')}) WINDOW p AS (PARTITION BY prefix, pack_no))
JOIN (SELECT pack_id, count(*) AS had FROM packs WHERE prefix IN (SELECT prefix FROM many) GROUP BY pack_id) USING (pack_id) WHERE NOT (one AND moved = 0 AND n = had)"""),
    "repository_sweep": q._repository("""
, held AS (SELECT s.*, coalesce(lang, 'none') AS repository FROM stored s JOIN documents USING (doc_id)),
good AS (SELECT repository, hash, suffix FROM held WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)), bad AS (SELECT repository, hash, suffix FROM held WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT repository, count(*) AS objects, CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER (gone) AS deleted, CAST(coalesce(sum(length) FILTER (gone), 0) AS BIGINT) AS freed
FROM (SELECT *, (repository, hash, suffix) NOT IN (SELECT (repository, hash, suffix) FROM good) AND (repository, hash, suffix) NOT IN (SELECT (repository, hash, suffix) FROM bad) AS gone FROM held) GROUP BY repository"""),
    "utc_stamps": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%a %b %-d %H:%M:%S UTC %Y') AS stamp FROM events",
    "url_objects": q._repository("SELECT doc_id, 'repo-' || suffix || '.org' AS repository, prefix, hash || suffix AS name, hash FROM stored"),
    "binary_entries": q._repository("""
SELECT hash || CASE suffix WHEN '' THEN '00' ELSE lower(hex(suffix)) END AS record, hash, suffix, row_number() OVER (PARTITION BY prefix ORDER BY hash, suffix)::INT AS place FROM (SELECT DISTINCT hash, suffix, prefix FROM stored)"""),
    "content_kinds": "SELECT sha1(o_orderkey::VARCHAR) AS hash, CASE o_orderstatus WHEN 'P' THEN 'L' ELSE '' END AS suffix FROM orders WHERE o_orderkey % 10 <> 0 AND coalesce(o_orderstatus, '') <> 'F'",
    "nested_edges": "SELECT 'R' || n_regionkey AS parent, sha1(n_name) AS child FROM nation WHERE n_nationkey % 5 <> 0",
    "manifest_scan": q._repository("""
SELECT doc_id::VARCHAR AS path, hash AS root, length AS size, reverse(hash) AS history, doc_id::BIGINT AS revision, doc_id % 3 <> 0 AS collectable, 'name ' || suffix AS name,
       array_to_string(list_sort([hash || 'C', 'firstH', reverse(hash) || 'H']), ' ') AS alive FROM stored"""),
}
