"""Queries over a virtual repository made of the driver's tables, each with its SQL.

Documents are stored objects, named by the SHA-1 of their text, with a suffix by their source. Documents labelled
good are reachable, those labelled bad are what a later mark finds. Region to lineitem is the graph of catalogs, events
are tags, and documents by doc_id modulo 4 are packs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stowage import functions as fn
from stowage import plans, sources
from stowage.operators import aggregates, joins, marking, windows
from stowage.session import materialise

Query = Callable[[SparkSession, str], DataFrame]
#: Objects of this size and more count as loose, in place of a limit that no document reaches.
LOOSE = 8192
PER_PACK = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffixes = F.array(*(F.lit(x) for x in ("", "C", "P", "L", "H", "X", "M")))
    docs = table(spark, sf_dir, "documents").where("text is not null")
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)", 1).try_cast("int"), F.lit(0))
    return docs.select("doc_id", F.sha1(F.col("text").cast("binary")).alias("hash"), F.get(suffixes, F.pmod(number, F.lit(7))).alias("suffix"), F.octet_length("text").cast("long").alias("length")).withColumn("prefix", fn.prefix(F.col("hash")))


def labelled(spark: SparkSession, sf_dir: str, quality: int) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(F.col("quality") == quality)
    return stored(spark, sf_dir).join(labels.select("doc_id"), "doc_id", "left_semi").select("hash", "suffix")


def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir, 1)


def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir, 0)


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).select(F.concat(F.lit("p"), F.pmod("doc_id", F.lit(4))).alias("pack_id"), "prefix", "hash", F.col("doc_id").alias("offset"), "length")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    node = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    leaf = F.concat(F.lit("L:"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"))
    parts = [
        t("nation").select(node("R", "n_regionkey").alias("parent"), node("N", "n_nationkey").alias("child")),
        t("customer").select(node("N", "c_nationkey"), node("C", "c_custkey")),
        t("supplier").select(node("N", "s_nationkey"), node("S", "s_suppkey")),
        t("orders").select(node("C", "o_custkey"), node("O", "o_orderkey")),
        t("lineitem").select(node("O", "l_orderkey"), leaf),
        t("lineitem").select(node("S", "l_suppkey"), leaf),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return materialise(out.distinct())  # each round of a mark reads it


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.concat(F.lit("R:"), F.col("r_regionkey")).alias("hash"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("name"), F.col("user_id").cast("string").alias("hash"), F.unix_micros(F.col("ts").cast("timestamp")).alias("revision"))


def line_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as catalog rows, external by their status, and lineitems as chunks."""
    digest = lambda *c: F.unhex(F.sha1(F.concat_ws("-", *c).cast("binary")))
    flags = F.when(F.col("o_orderstatus") == "F", 132).otherwise(68).cast("long")
    catalog = table(spark, sf_dir, "orders").select(F.lit("c").alias("catalog_hash"), F.col("o_orderkey").alias("md5path_1"), F.lit(0).cast("long").alias("md5path_2"), digest("o_orderkey").alias("hash"), flags.alias("flags"))
    chunks = table(spark, sf_dir, "lineitem").select(F.lit("c").alias("catalog_hash"), F.col("l_orderkey").alias("md5path_1"), F.lit(0).cast("long").alias("md5path_2"), digest("l_orderkey", "l_linenumber").alias("hash"))
    return catalog, chunks


def gc_two_pass(s: SparkSession, d: str) -> DataFrame:
    objects = stored(s, d)
    return plans.summary(objects, plans.two_pass(objects, reachable(s, d), lambda: delta(s, d)))


def mark_bfs_bag(s: SparkSession, d: str) -> DataFrame:
    graph, start = edges(s, d), roots(s, d)
    refs = graph.select(F.col("parent").alias("catalog_hash"), F.sha1(F.col("child").cast("binary")).alias("hash"), F.lit("").alias("suffix"))
    bag = marking.emitted(marking.mark(start, graph), start, graph, refs)
    return bag.groupBy("suffix").agg(F.count(F.lit(1)).alias("emitted"), F.countDistinct("hash").alias("unique_hashes"))


def seen_catalogs(s: SparkSession, d: str) -> DataFrame:
    """Everything below Africa, which an earlier mark has seen."""
    return marking.mark(roots(s, d).where("hash = 'R:0'"), edges(s, d))


def mark_delta(s: SparkSession, d: str) -> DataFrame:
    return marking.mark(roots(s, d), edges(s, d), seen=seen_catalogs(s, d)).select("hash")


def mark_mirror(s: SparkSession, d: str) -> DataFrame:
    """Suppliers were processed before; what only they lead to is not visited."""
    processed = table(s, d, "supplier").select(F.concat(F.lit("S:"), F.col("s_suppkey")).alias("hash"))
    visited, _ = marking.mark_fetching(roots(s, d), marking.by_edges(edges(s, d)), processed, lambda f: f.withColumn("ok", F.lit(True)))
    return visited.select("hash")


def resolve_object(s: SparkSession, d: str) -> DataFrame:
    objects = stored(s, d)
    wanted = objects.select("hash", "suffix").distinct()
    bad = delta(s, d).select("hash").distinct()
    return joins.resolve(wanted, objects.where(F.col("length") >= LOOSE), packs(s, d).join(reachable(s, d).select("hash").distinct(), "hash", "left_semi"), bad)


def compact_plan(s: SparkSession, d: str) -> DataFrame:
    return plans.compaction(packs(s, d), reachable(s, d), per_pack=PER_PACK).layout.select("prefix", "pack_no", "hash", "new_offset", "length", "pack_id", "offset")


def chunk_refs(s: SparkSession, d: str) -> DataFrame:
    catalog, chunks = line_chunks(s, d)
    return joins.chunk_refs(chunks, catalog).groupBy("hash", "suffix").agg(F.count(F.lit(1)).alias("n"))


def content_refs(s: SparkSession, d: str) -> DataFrame:
    return joins.content_refs(line_chunks(s, d)[0]).select("hash", "suffix")


def loose_names(s: SparkSession, d: str) -> DataFrame:
    """Stored objects by name; those of no suffix bear one that isn't hex, and are skipped."""
    name = F.when(F.col("suffix") == "", F.concat(F.lit("zz"), F.col("hash"))).otherwise(fn.full_name(F.col("hash"), F.col("suffix")))
    return stored(s, d).select(name.alias("name"), "length")


MANIFEST_TEXTS = (
    ("all", "Caa11\nB100\nRr\nHbb22\nXcc33\nMdd44\nS7\nGyes\nNtest.repo"),
    ("crlf", "Caa11\r\nGno\r\nS12\r\nC\r\n"),
    ("last", "Cfirst\nCsecond\nG1"),
    ("signed", "Cee55\n--\nCforged\nHforged"),
    ("rootless", "Nonly.name\nGtrue"),
)


def manifest_parse(s: SparkSession, d: str) -> DataFrame:
    return sources.parse_manifests(s.createDataFrame(list(MANIFEST_TEXTS), "path string, text string")).drop("extras")


def object_names(s: SparkSession, d: str) -> DataFrame:
    h, x = F.col("hash"), F.col("suffix")
    return stored(s, d).select("doc_id", fn.full_name(h, x).alias("name"), fn.object_path(h, x).alias("path"), fn.suffix_of_name(fn.full_name(h, x)).alias("read_back"), fn.human_bytes(F.col("length")).alias("size"), fn.suffix_label(x).alias("label"))


QUERIES: dict[str, Query] = {
    "gc_two_pass": gc_two_pass,
    "sweep_candidates": lambda s, d: plans.single_pass(stored(s, d), reachable(s, d)).select("doc_id", "hash", "suffix"),
    "sweep_candidates_by_hash": lambda s, d: joins.unreachable(stored(s, d), reachable(s, d), joins.HASH).select("doc_id", "hash", "suffix"),
    "sweep_retained": lambda s, d: joins.retained(stored(s, d), reachable(s, d)).select("doc_id", "hash", "suffix"),
    "sweep_by_suffix": lambda s, d: aggregates.by_suffix(plans.single_pass(stored(s, d), reachable(s, d))),
    "sweep_totals": lambda s, d: aggregates.sweep_totals(stored(s, d), reachable(s, d), joins.HASH_SUFFIX),
    "delta_protected": lambda s, d: joins.protect(plans.single_pass(stored(s, d), reachable(s, d)), delta(s, d))[1].select("doc_id", "hash", "suffix"),
    "compact_keep": lambda s, d: joins.compacted(packs(s, d), reachable(s, d)),
    "compact_drop": lambda s, d: joins.dropped(packs(s, d), reachable(s, d)),
    "compact_stats_by_prefix": lambda s, d: aggregates.compaction_stats(packs(s, d), reachable(s, d)),
    "compact_plan": compact_plan,
    "loose_cleanup": lambda s, d: aggregates.loose_stats(joins.loose_reachability(loose_names(s, d), reachable(s, d))),
    "content_refs": content_refs,
    "chunk_refs": chunk_refs,
    "reachable_distinct": lambda s, d: aggregates.distinct_entries(aggregates.union_all(reachable(s, d), delta(s, d))),
    "dup_accounting": lambda s, d: aggregates.duplicates(aggregates.union_all(reachable(s, d), delta(s, d))),
    "tag_roots": lambda s, d: windows.tagged_roots(tags(s, d), "1"),
    "tag_preview": lambda s, d: windows.preview(windows.tagged_roots(tags(s, d))),
    "mark_bfs": lambda s, d: marking.mark(roots(s, d), edges(s, d)).select("hash"),
    "mark_bfs_bag": mark_bfs_bag,
    "mark_delta": mark_delta,
    "mark_mirror": mark_mirror,
    "to_fetch": lambda s, d: plans.fetch_plan(delta(s, d), reachable(s, d), packs(s, d).where(F.col("length") < 1000)),
    "size_class": lambda s, d: aggregates.outcomes(stored(s, d).withColumn("outcome", fn.size_class(F.col("length"), LOOSE))),
    "pack_lookup": lambda s, d: joins.lookup(delta(s, d).select("hash").distinct(), packs(s, d)),
    "resolve_object": resolve_object,
    "pack_layout": lambda s, d: windows.pack_layout(stored(s, d).groupBy("hash").agg(F.min("length").alias("length")), PER_PACK),
    "fanout": lambda s, d: aggregates.fanout(aggregates.distinct_entries(stored(s, d))),
    "fragmented_prefixes": lambda s, d: aggregates.fragmented(packs(s, d)),
    "store_totals": lambda s, d: aggregates.store_totals(packs(s, d)),
    "inventory_summary": lambda s, d: aggregates.inventory(stored(s, d)),
    "nonempty_prefixes": lambda s, d: aggregates.used_prefixes(stored(s, d)),
    "object_path": object_names,
    "manifest_parse": manifest_parse,
}

REPOSITORY = """
stored AS (
  SELECT doc_id, sha1(text) AS hash, substr(sha1(text), 1, 2) AS prefix, strlen(text) AS length,
         (['', 'C', 'P', 'L', 'H', 'X', 'M'])[coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS INT), 0) % 7 + 1] AS suffix
  FROM documents WHERE text IS NOT NULL
), reachable AS (
  SELECT hash, suffix FROM stored WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
), delta AS (
  SELECT hash, suffix FROM stored WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)
), packs AS (
  SELECT 'p' || (doc_id % 4) AS pack_id, prefix, hash, doc_id AS "offset", length FROM stored
), candidates AS (
  SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM reachable r WHERE r.hash = s.hash AND r.suffix = s.suffix)
), copies AS (
  SELECT *, row_number() OVER (PARTITION BY hash ORDER BY pack_id, "offset") AS copy FROM packs
), kept AS (
  SELECT pack_id, prefix, hash, "offset", length FROM copies WHERE copy = 1 AND hash IN (SELECT hash FROM reachable)
)"""
GRAPH = """
edges AS (
  SELECT 'R:' || n_regionkey AS parent, 'N:' || n_nationkey AS child FROM nation
  UNION SELECT 'N:' || c_nationkey, 'C:' || c_custkey FROM customer
  UNION SELECT 'N:' || s_nationkey, 'S:' || s_suppkey FROM supplier
  UNION SELECT 'C:' || o_custkey, 'O:' || o_orderkey FROM orders
  UNION SELECT 'O:' || l_orderkey, 'L:' || l_orderkey || '-' || l_linenumber FROM lineitem
  UNION SELECT 'S:' || l_suppkey, 'L:' || l_orderkey || '-' || l_linenumber FROM lineitem
), roots AS (
  SELECT 'R:' || r_regionkey AS hash FROM region
), visited AS (
  SELECT hash FROM roots UNION SELECT child FROM edges JOIN visited ON parent = hash
)"""
LABEL = "CASE suffix WHEN '' THEN 'content' WHEN 'C' THEN 'catalog' WHEN 'P' THEN 'partial chunk' WHEN 'L' THEN 'micro-catalog' WHEN 'H' THEN 'history' WHEN 'X' THEN 'certificate' WHEN 'M' THEN 'metainfo' ELSE 'other' END"


def _repository(sql: str) -> str:
    return f"WITH {REPOSITORY}\n{sql}"


def _graph(sql: str) -> str:
    return f"WITH RECURSIVE {GRAPH}{sql}"


def _layout(objects: str, offset: str, more: str = "") -> str:
    return f"""SELECT prefix, pack_no, hash, CAST(coalesce(sum(length) OVER (PARTITION BY prefix, pack_no ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS {offset}, length{more}
FROM (SELECT *, CAST((row_number() OVER (PARTITION BY prefix ORDER BY hash) - 1) // {PER_PACK} AS BIGINT) AS pack_no FROM ({objects}))"""


ORACLES: dict[str, str] = {
    "gc_two_pass": _repository(f"""
SELECT suffix, {LABEL} AS label, count(*) AS checked, count(*) FILTER (gone AND safe) AS protected, count(*) FILTER (gone AND NOT safe) AS deleted,
       CAST(coalesce(sum(length) FILTER (gone AND NOT safe), 0) AS BIGINT) AS bytes, round(100.0::DOUBLE * count(*) FILTER (gone AND NOT safe) / count(*), 4) AS percent
FROM (SELECT *, (hash, suffix) NOT IN (SELECT (hash, suffix) FROM reachable) AS gone, (hash, suffix) IN (SELECT (hash, suffix) FROM delta) AS safe FROM stored) GROUP BY suffix"""),
    "sweep_candidates": _repository("SELECT doc_id, hash, suffix FROM candidates"),
    "sweep_candidates_by_hash": _repository("SELECT doc_id, hash, suffix FROM stored WHERE hash NOT IN (SELECT hash FROM reachable)"),
    "sweep_retained": _repository("SELECT doc_id, hash, suffix FROM stored s WHERE EXISTS (SELECT 1 FROM reachable r WHERE r.hash = s.hash AND r.suffix = s.suffix)"),
    "sweep_by_suffix": _repository("SELECT suffix, count(*) AS objects, CAST(sum(length) AS BIGINT) AS bytes FROM candidates GROUP BY suffix"),
    "sweep_totals": _repository("""
SELECT (SELECT count(*) FROM stored) AS checked, (SELECT count(*) FROM stored) - count(*) AS retained, count(*) AS candidates,
       CAST(coalesce(sum(length), 0) AS BIGINT) AS candidate_bytes, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM stored), 4) AS percent FROM candidates"""),
    "delta_protected": _repository("SELECT doc_id, hash, suffix FROM candidates c WHERE EXISTS (SELECT 1 FROM delta r WHERE r.hash = c.hash AND r.suffix = c.suffix)"),
    "compact_keep": _repository("SELECT * FROM kept"),
    "compact_drop": _repository("""SELECT pack_id, prefix, hash, "offset", length, CASE WHEN copy > 1 THEN 'copy' ELSE 'unreachable' END AS why FROM copies WHERE copy > 1 OR hash NOT IN (SELECT hash FROM reachable)"""),
    "compact_stats_by_prefix": _repository("""
SELECT prefix, count(DISTINCT pack_id) AS packs, count(*) FILTER (copy = 1 AND live) AS kept, count(*) FILTER (copy = 1 AND NOT live) AS removed,
       CAST(greatest(sum(length) - coalesce(sum(length) FILTER (copy = 1 AND live), 0), 0) AS BIGINT) AS reclaimed
FROM (SELECT *, hash IN (SELECT hash FROM reachable) AS live FROM copies) GROUP BY prefix"""),
    "compact_plan": _repository(f"""SELECT * EXCLUDE (had, n, one, moved) FROM (SELECT *, count(*) OVER p AS n, min(pack_id) OVER p = max(pack_id) OVER p AS one, count(*) FILTER ("offset" <> new_offset) OVER p AS moved FROM ({_layout("SELECT * FROM kept", "new_offset", ', pack_id, "offset"')}) WINDOW p AS (PARTITION BY prefix, pack_no))
JOIN (SELECT pack_id, count(*) AS had FROM packs GROUP BY pack_id) USING (pack_id) WHERE NOT (one AND moved = 0 AND n = had)"""),
    "loose_cleanup": _repository("""
SELECT count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS deleted, CAST(coalesce(sum(length) FILTER (NOT kept), 0) AS BIGINT) AS bytes_freed
FROM (SELECT length, substr(name, 1, 40) IN (SELECT hash FROM reachable) AS kept FROM (SELECT length, CASE suffix WHEN '' THEN 'zz' || hash ELSE hash || suffix END AS name FROM stored) WHERE regexp_matches(name, '^[0-9a-fA-F]{40}'))"""),
    "content_refs": "SELECT sha1(o_orderkey::VARCHAR) AS hash, '' AS suffix FROM orders WHERE o_orderstatus <> 'F' OR o_orderstatus IS NULL",
    "chunk_refs": "SELECT sha1(l_orderkey || '-' || l_linenumber) AS hash, 'P' AS suffix, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' OR o_orderstatus IS NULL GROUP BY ALL",
    "reachable_distinct": _repository("SELECT * FROM reachable UNION SELECT * FROM delta"),
    "dup_accounting": _repository("SELECT count(*) AS entries, count(DISTINCT hash || suffix) AS unique_entries, count(*) - count(DISTINCT hash || suffix) AS duplicate_entries FROM (SELECT * FROM reachable UNION ALL SELECT * FROM delta)"),
    "tag_roots": "SELECT event_id::VARCHAR AS name, user_id::VARCHAR AS hash, epoch_us(ts) AS revision FROM events WHERE user_id <> 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) = 1",
    "tag_preview": "SELECT *, greatest((SELECT count(DISTINCT user_id) FROM events) - 10, 0)::INT AS more FROM (SELECT event_id::VARCHAR AS name, user_id::VARCHAR AS hash, epoch_us(ts) AS revision FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) = 1) ORDER BY revision, name LIMIT 10",
    "mark_bfs": _graph(" SELECT hash FROM visited"),
    "mark_bfs_bag": _graph(""", named AS (SELECT child FROM edges JOIN visited ON parent = hash)
SELECT 'C' AS suffix, count(*) AS emitted, count(DISTINCT hash) AS unique_hashes FROM (SELECT hash FROM roots UNION ALL SELECT child FROM named)
UNION ALL SELECT '', count(*), count(DISTINCT sha1(child)) FROM named"""),
    "mark_delta": _graph(""", seen AS (SELECT 'R:0' AS hash UNION SELECT child FROM edges JOIN seen ON parent = hash),
fresh AS (SELECT hash FROM roots WHERE hash <> 'R:0' UNION SELECT child FROM edges JOIN fresh ON parent = hash WHERE child NOT IN (SELECT hash FROM seen)) SELECT hash FROM fresh"""),
    "mark_mirror": _graph(""", fresh AS (SELECT hash FROM roots UNION SELECT child FROM edges JOIN fresh ON parent = hash WHERE child NOT IN (SELECT 'S:' || s_suppkey FROM supplier)) SELECT hash FROM fresh"""),
    "to_fetch": _repository("SELECT DISTINCT hash, suffix FROM delta d WHERE NOT EXISTS (SELECT 1 FROM reachable r WHERE r.hash = d.hash AND r.suffix = d.suffix) AND hash NOT IN (SELECT hash FROM packs WHERE length < 1000)"),
    "size_class": _repository(f"SELECT CASE WHEN length >= {LOOSE} THEN 'loose' ELSE 'packed' END AS outcome, count(*) AS objects, CAST(sum(length) AS BIGINT) AS bytes FROM stored GROUP BY 1"),
    "pack_lookup": _repository("""SELECT hash, pack_id, "offset", length FROM copies WHERE copy = 1 AND hash IN (SELECT hash FROM delta)"""),
    "resolve_object": _repository(f"""
, loose AS (SELECT DISTINCT hash, suffix FROM stored WHERE length >= {LOOSE}), wanted AS (SELECT DISTINCT hash, suffix FROM stored)
SELECT w.hash, w.suffix, CASE WHEN l.hash IS NOT NULL THEN 'loose' WHEN k.hash IS NOT NULL THEN 'pack' WHEN w.hash IN (SELECT hash FROM delta) THEN 'upstream' ELSE 'missing' END AS place,
       CASE WHEN l.hash IS NULL THEN k.pack_id END AS pack_id, CASE WHEN l.hash IS NULL THEN k."offset" END AS "offset", CASE WHEN l.hash IS NULL THEN k.length END AS length
FROM wanted w LEFT JOIN loose l ON l.hash = w.hash AND l.suffix = w.suffix LEFT JOIN kept k ON k.hash = w.hash"""),
    "pack_layout": _repository(_layout("SELECT hash, substr(hash, 1, 2) AS prefix, min(length) AS length FROM stored GROUP BY hash", '"offset"')),
    "fanout": _repository("SELECT CAST(b AS INT) AS byte1, (SELECT count(*) FROM (SELECT DISTINCT hash, suffix FROM stored) WHERE CAST('0x' || substr(hash, 3, 2) AS INT) <= b) AS total FROM range(256) t(b)"),
    "fragmented_prefixes": _repository("SELECT prefix, count(DISTINCT pack_id) AS packs FROM packs GROUP BY prefix HAVING count(DISTINCT pack_id) > 3"),
    "store_totals": _repository("SELECT CAST(sum(n) AS BIGINT) AS objects, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(p) AS BIGINT) AS packs, max(p) AS most_packs FROM (SELECT prefix, count(*) AS n, sum(length) AS b, count(DISTINCT pack_id) AS p FROM packs GROUP BY prefix)"),
    "inventory_summary": _repository("SELECT prefix, count(*) AS objects, CAST(sum(length) AS BIGINT) AS bytes FROM stored GROUP BY prefix"),
    "nonempty_prefixes": _repository("SELECT count(DISTINCT prefix) AS prefixes FROM stored"),
    "object_path": _repository(f"""
SELECT doc_id, hash || suffix AS name, substr(hash, 1, 2) || '/' || substr(hash, 3) || suffix AS path, suffix AS read_back,
       CASE WHEN length < 1024 THEN length || ' B' WHEN length < 1048576 THEN printf('%.1f', length / 1024.0::DOUBLE) || ' KB' ELSE printf('%.1f', length / 1048576.0::DOUBLE) || ' MB' END AS size, {LABEL} AS label FROM stored"""),
    "manifest_parse": """
SELECT path, root, size::BIGINT AS size, root_path, history, certificate, metainfo, revision::BIGINT AS revision, collectable, name FROM (VALUES
  ('all', 'aa11', 100, 'r', 'bb22', 'cc33', 'dd44', 7, true, 'test.repo'), ('crlf', 'aa11', NULL, NULL, NULL, NULL, NULL, 12, false, NULL),
  ('last', 'second', NULL, NULL, NULL, NULL, NULL, NULL, true, NULL), ('signed', 'ee55', NULL, NULL, NULL, NULL, NULL, NULL, true, NULL),
  ('rootless', NULL, NULL, NULL, NULL, NULL, NULL, NULL, true, 'only.name')) t(path, root, size, root_path, history, certificate, metainfo, revision, collectable, name)""",
}
