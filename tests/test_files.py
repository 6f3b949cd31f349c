"""Sources, sinks, marking and incremental runs on small fixtures in temporary folders."""

import hashlib
import os
import sqlite3
import threading
import zlib
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stowage import functions as fn
from stowage import model, plans, sinks, sources, streaming
from stowage.operators import aggregates, joins, marking, windows

ENTRY, PACK = "hash string, suffix string", "pack_id string, prefix string, hash string, offset long, length long"


def pad(s, n=40):
    return (s * n)[:n]


# The tables of a catalog, as the file format has them.
CATALOG_TABLES = """
CREATE TABLE properties (key TEXT, value TEXT);
CREATE TABLE catalog (md5path_1 INTEGER, md5path_2 INTEGER, parent_1 INTEGER, parent_2 INTEGER, hardlinks INTEGER, hash BLOB, size INTEGER, mode INTEGER, mtime INTEGER, flags INTEGER, name TEXT, symlink TEXT, uid INTEGER, gid INTEGER, xattr BLOB);
CREATE TABLE chunks (md5path_1 INTEGER, md5path_2 INTEGER, offset INTEGER, size INTEGER, hash BLOB);
CREATE TABLE nested_catalogs (path TEXT, sha1 TEXT, size INTEGER);
"""


def catalog_db(path, rows=(), chunks=(), nested=(), schema="2.5", compress=True):
    db = sqlite3.connect(":memory:")
    db.executescript(CATALOG_TABLES)
    if schema:
        db.execute("INSERT INTO properties VALUES ('schema', ?)", (schema,))
    db.executemany("INSERT INTO catalog (md5path_1, md5path_2, hash, flags, name) VALUES (?, ?, ?, ?, 'n')", [(a, b, h and bytes.fromhex(h), f) for a, b, h, f in rows])
    db.executemany("INSERT INTO chunks VALUES (?, ?, ?, ?, ?)", [(a, b, o, n, bytes.fromhex(h)) for a, b, o, n, h in chunks])
    db.executemany("INSERT INTO nested_catalogs VALUES (?, ?, 1)", nested)
    db.commit()
    data = db.serialize()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(zlib.compress(data) if compress else data)


def named(text):
    return hashlib.sha1(text.encode()).hexdigest()


# a file, an external one, a directory without a hash, one with its own catalog, a file in two parts, an empty hash, an external file in one part
CONTENT = [(11, 21, named("plain"), 4), (12, 22, named("elsewhere"), 4 | 128), (13, 23, None, 1), (14, 24, named("folder"), 1), (15, 25, named("whole"), 4 | 64), (16, 26, "", 4), (17, 27, named("far"), 4 | 64 | 128)]
CHUNKS = [(15, 25, 0, 900, named("part one")), (15, 25, 900, 37, named("part two")), (17, 27, 0, 5, named("far part")), (18, 28, 0, 5, named("of no file"))]


def refs_of(files):
    catalog = sources.catalog_table(files, "catalog")
    return joins.content_refs(catalog).unionByName(joins.chunk_refs(sources.catalog_table(files, "chunks"), catalog))


def test_catalog_content(spark, tmp_path):
    read = sources.file_reader(str(tmp_path))
    for k, (schema, compress, n) in enumerate((("2.5", True, 5), (None, False, 5), ("2.3", True, 3))):
        root = f"{k}" * 40
        catalog_db(f"{tmp_path}/{root[:2]}/{root[2:]}C", CONTENT, CHUNKS, [("", ""), ("/x", named("below"))], schema, compress)
        files = sources.catalog_files(spark.createDataFrame([(root,)], "hash string"), read)
        rows = refs_of(files).collect()
        assert {(r["hash"], r["suffix"]) for r in rows if r["suffix"] != "P"} == {(named("plain"), ""), (named("folder"), "L"), (named("whole"), "")}
        assert {r["hash"] for r in rows if r["suffix"] == "P"} == ({named("part one"), named("part two")} if n == 5 else set()) and len(rows) == n
        assert [tuple(r) for r in joins.nested_edges(sources.catalog_table(files, "nested_catalogs")).collect()] == [(root, named("below"))]
        # the same from one opening, with filters and join in SQLite and no shuffle
        refs = sources.catalog_refs(files)
        assert sorted((r["hash"], r["suffix"]) for r in refs.collect() if r["kind"] != "nested") == sorted((r["hash"], r["suffix"]) for r in rows)
        assert [(r["catalog_hash"], r["hash"], r["suffix"]) for r in refs.where("kind = 'nested'").collect()] == [(root, named("below"), "C")]
        given = spark.createDataFrame([(root, bytearray(read(root, "C")))], "hash string, content binary")
        assert "Exchange" not in sources.catalog_refs(given)._jdf.queryExecution().executedPlan().toString()
    with open(f"{tmp_path}/00/{pad('0')[2:]}C", "wb") as f:
        f.write(b"broken")
    for table in (refs_of, sources.catalog_refs):
        with pytest.raises(PySparkException, match="BadDatabase"):
            table(sources.catalog_files(spark.createDataFrame([(pad("0"),)], "hash string"), read)).collect()
    with pytest.raises(PySparkException):
        sources.catalog_files(spark.createDataFrame([(pad("77"),)], "hash string"), read).collect()


def test_walk_of_catalog_files(spark, tmp_path):
    """Depth 4, branching 3, one shared content hash: 40 catalogs, 80 entries."""
    names = iter(f"{i:040x}" for i in range(1, 100))

    def build(depth):
        own, children = next(names), [build(depth - 1) for _ in range(3)] if depth > 1 else []
        catalog_db(f"{tmp_path}/{own[:2]}/{own[2:]}C", [(1, 1, pad("b"), 4)], nested=[(f"/{c}", c) for c in children])
        return own

    roots, read = spark.createDataFrame([(build(4),)], "hash string"), sources.file_reader(str(tmp_path))
    children = lambda f: joins.nested_edges(sources.catalog_table(sources.catalog_files(f, read), "nested_catalogs")).select(F.col("child").alias("hash"))
    visited = marking.walk(roots, children)
    assert visited.count() == 40 and visited.agg(F.max("depth")).first()[0] == 3
    files = sources.catalog_files(visited, read)
    bag = marking.emitted(visited, roots, joins.nested_edges(sources.catalog_table(files, "nested_catalogs")), refs_of(files))
    assert bag.count() == 80
    opened = spark.sparkContext.accumulator(0)

    def counted(hash_, suffix):
        opened.add(1)
        return read(hash_, suffix)

    visited, refs = marking.mark_reading(roots, lambda f: sources.catalog_refs(sources.catalog_files(f, counted)))
    assert visited.count() == 40 and marking.named_entries(visited, roots, refs).count() == 80 and opened.value == 40


def test_walk_of_a_deep_tree(spark):
    """Visited nodes stay in few tables, however deep the graph is."""
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)], "parent string, child string")
    found = marking.walk(spark.createDataFrame([("n0",)], "hash string"), marking.by_edges(edges))
    assert {(r["hash"], r["depth"]) for r in found.collect()} == {(f"n{i}", i) for i in range(41)}
    assert len(found.inputFiles()) <= 4 * 8


def graph(spark, edges, content):
    e = spark.createDataFrame(edges, "parent string, child string")
    return e, spark.createDataFrame([(c, h, "") for c, h in content], "catalog_hash string, hash string, suffix string")


def test_marking(spark):
    one = lambda *h: spark.createDataFrame([(x,) for x in h], "hash string")
    edges, refs = graph(spark, [("r", f"n{i}") for i in range(10)], [(f"n{i}", "content") for i in range(10)])
    assert marking.emitted(marking.mark(one("r"), edges), one("r"), edges, refs).count() == 21
    edges, refs = graph(spark, [("r", "n1"), ("r", "n2"), ("n1", "leaf"), ("n2", "leaf")], [])  # a diamond
    visited = marking.mark(one("r", "r"), edges)
    assert visited.count() == 4 and marking.emitted(visited, one("r"), edges, refs).count() == 5
    edges, refs = graph(spark, [("r2", "A"), ("r2", "C"), ("A", "B")], [("C", "contentC"), ("B", "old")])
    seen = one("r", "A", "B")
    fresh = marking.mark(one("r2"), edges, seen=seen)
    assert {tuple(x) for x in marking.emitted(fresh, one("r2"), edges, refs, seen).collect()} == {("r2", "C"), ("C", "C"), ("contentC", "")}
    assert marking.mark(one("A"), edges, seen=seen).count() == 0
    with pytest.raises(marking.MissingCatalogs):
        marking.mark(one("r2"), edges, catalogs=one("r2", "A", "B"))
    again = lambda: (one("r2"), edges, refs)
    stored = spark.createDataFrame([("contentC", "", 5), ("old", "", 7), ("junk", "", 9)], ENTRY + ", length long")
    first, first_refs = graph(spark, [("r", "A"), ("A", "B")], [("B", "old")])
    out = plans.collect_garbage(stored, one("r"), first, first_refs, again)
    assert {r["hash"] for r in out.candidates.collect()} == {"contentC", "junk"}
    assert [r["hash"] for r in out.protected.collect()] == ["contentC"] and [r["hash"] for r in out.to_delete.collect()] == ["junk"]


def test_functions(spark):
    df = spark.createDataFrame([("ab", "C"), ("", ""), (pad("0123456789abcdef"), "P")], ENTRY)
    h, s = F.col("hash"), F.col("suffix")
    assert [r[0] for r in df.select(fn.object_path(h, s)).collect()] == ["ab", "", "01/" + pad("0123456789abcdef")[2:] + "P"]
    entries = df.where("length(hash) = 40").select(fn.to_binary(h, s).alias("e"))
    back = fn.from_binary(F.col("e"))
    assert tuple(entries.select(*back).first()) == (pad("0123456789abcdef"), "P") and len(entries.first()[0]) == 21
    assert df.select(fn.to_binary(h, s)).first()[0] is None
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(fn.suffix_of_name(F.lit("abP"))) == "P" and one(fn.suffix_of_name(F.lit("abp"))) == ""
    assert one(fn.hash_of_name(F.lit(pad("a") + "C"))) == pad("a") and one(fn.hash_of_name(F.lit(pad("z")))) is None
    assert [one(fn.human_bytes(F.lit(n))) for n in (5, 1024, 1536, 5 << 20)] == ["5 B", "1.0 KB", "1.5 KB", "5.0 MB"]
    assert tuple(spark.range(1).select(*fn.url_object(F.lit("/repo/data/ab/" + pad("c", 38) + "P"))).first()) == ("ab", "ab" + pad("c", 38) + "P", "ab" + pad("c", 38))
    assert tuple(spark.range(1).select(*fn.url_object(F.lit("/x"))).first()) == (None, None, None)
    assert one(fn.repository_name(F.lit("/a.b/data/x"))) == "a.b" and one(fn.percentage(F.lit(1), F.lit(0))) is None


def test_stamps_are_utc_in_every_zone(spark):
    """In zones with clock changes too: hours that a zone skips, and hours that it has twice."""
    seconds = [0, 1704164645, 1710054000, 1710055800, 1730611800, 1730615400, 1540695600, 951782399]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "America/Sao_Paulo", "Asia/Kolkata", "Europe/London"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            t = F.timestamp_seconds("s")
            for r in spark.createDataFrame([(s,) for s in seconds], "s long").select("s", fn.rfc3339(t).alias("a"), fn.utc_stamp(t).alias("b")).collect():
                at = datetime.fromtimestamp(r["s"], UTC)
                assert r["a"] == at.strftime("%Y-%m-%dT%H:%M:%SZ") and r["b"] == at.strftime("%a %b ") + f"{at.day}" + at.strftime(" %H:%M:%S UTC %Y")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_tags(spark, tmp_path):
    def history(rows, name, create=True):
        db = sqlite3.connect(":memory:")
        if create:
            db.execute("CREATE TABLE tags (name TEXT PRIMARY KEY, hash TEXT, revision INTEGER, timestamp INTEGER, channel INTEGER, description TEXT, size INTEGER, branch TEXT)")
            db.executemany("INSERT INTO tags (name, hash, revision) VALUES (?, ?, ?)", rows)
        else:
            db.execute("CREATE TABLE other (x)")
        db.commit()
        return (name, bytearray(zlib.compress(db.serialize())))

    files = [history([("b", "h1", 3), ("a", "h1", 2), ("c", None, 1), ("d", "", 1), ("e", "cur", 1)], "x"), history([], "y", create=False)]
    tags = sources.history_tags(spark.createDataFrame(files, "hash string, content binary"))
    assert [tuple(r) for r in windows.tagged_roots(tags, "cur").collect()] == [("a", "h1", 2)]
    with pytest.raises(PySparkException, match="BadDatabase"):
        sources.history_tags(spark.createDataFrame([("x", bytearray(b"junk"))], "hash string, content binary")).collect()


def test_manifests(spark, tmp_path):
    path = f"{tmp_path}/manifest"
    with open(path, "w") as f:
        f.write("Cold\nCaa\nHbb\nXcc\nHb2\nS5\nGno\n--\nCforged\nHforged\n")
    m = sources.read_manifest(spark, path)
    # the last root counts, and every history, certificate and metainfo stays alive
    assert sources.manifest_roots(m) == [("aa", "C"), ("bb", "H"), ("cc", "X"), ("b2", "H")] and m["revision"] == 5 and not m["collectable"] and m["history"] == "b2"
    texts = spark.createDataFrame([("p", "Cold\nCaa\nMm" + "x" * 2_000_000), ("q", None)], "path string, text string")
    rows = sources.manifest_entries(sources.parse_manifests(texts)).collect()
    assert [(r["path"], r["hash"][:3], len(r["hash"]), r["suffix"]) for r in rows] == [("p", "aa", 2, "C"), ("p", "mxx", 2_000_001, "M")]
    with open(path, "w") as f:
        f.write("Nname\n--\nCaa")
    with pytest.raises(sources.BadManifest):
        sources.read_manifest(spark, path)


def test_loose_sweep(spark, tmp_path):
    def put(name, text="seven b"):
        os.makedirs(f"{tmp_path}/{name[:2]}", exist_ok=True)
        with open(f"{tmp_path}/{name[:2]}/{name[2:]}", "w") as f:
            f.write(text)

    names = ["11" + pad("a", 38), "22" + pad("b", 38), "11" + pad("z", 38), "22" + pad("z", 38), "44" + pad("e", 38), "bb" + pad("2", 38) + "C", "cc" + pad("3", 38) + "P"]
    for n in names:
        put(n)
    stored = sources.loose_objects(spark, str(tmp_path))
    reach = spark.createDataFrame([(names[0], ""), (names[1], ""), (names[5][:40], "")], ENTRY)
    gone = plans.single_pass(stored, reach)
    assert {r["name"] for r in gone.collect()} == set(names[2:])  # names that aren't hex are swept, suffixes count
    planned = sinks.delete_files(gone)
    assert {r["outcome"] for r in planned.collect()} == {"planned"} and stored.count() == 7
    assert {r["suffix"]: r["objects"] for r in aggregates.by_suffix(gone).collect()} == {"": 3, "C": 1, "P": 1}
    judged = joins.loose_reachability(stored, reach)
    assert tuple(aggregates.loose_stats(judged).first()) == (3, 2, 14)  # by hash alone, and names that aren't hex are skipped
    sinks.write_list(gone, f"{tmp_path}-list")
    assert {r["value"] for r in spark.read.text(f"{tmp_path}-list").collect()} == set(names[2:])
    assert sources.list_objects(spark, str(tmp_path)).where("error is not null").count() == 0 and sources.loose_objects(spark, f"{tmp_path}/none").count() == 0
    done = sinks.delete_files(gone, really=True)
    assert {r["outcome"] for r in done.collect()} == {"deleted"}
    assert {r["name"] for r in sources.loose_objects(spark, str(tmp_path)).collect()} == set(names[:2])
    assert {r["outcome"] for r in sinks.delete_files(done.select("path", "length", "suffix"), really=True).collect()} == {"absent"}


def test_chunks(spark, tmp_path):
    rows = [(bytes([i >> 8 & 255, i & 255, i >> 16 & 255, *((i * 7 + j * 13) & 255 for j in range(3, 20))]).hex(), "CP"[i % 2] if i % 3 else "") for i in range(2000)]
    df = spark.createDataFrame(rows + rows[:50], ENTRY)
    paths = sinks.write_chunks(df, f"{tmp_path}/chunks")
    assert [os.path.basename(p) for p in paths] == sorted({f"chunk-{h[:2]}" for h, _ in rows})
    for p in paths:
        with open(p, "rb") as f:
            data = f.read()
        records = [data[i : i + 21] for i in range(0, len(data), 21)]
        assert records == sorted(set(records)) and all(r[:1].hex() == p[-2:] for r in records)
    assert {tuple(r) for r in sources.read_chunks(spark, f"{tmp_path}/chunks").collect()} == set(rows)
    two = sorted({h[:2] for h, _ in rows})[:2]
    assert {tuple(r) for r in sources.read_chunks(spark, f"{tmp_path}/chunks", two).collect()} == {x for x in rows if x[0][:2] in two}
    assert {r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(sources.chunk_prefix(F.col("p"))).collect()} == {h[:2] for h, _ in rows}
    sinks.write_chunks(df, f"{tmp_path}/all", dedup=False)
    assert sources.read_chunks(spark, f"{tmp_path}/all").count() == len(rows) + 50
    sinks.write_entries(df, f"{tmp_path}/entries")
    assert spark.read.parquet(f"{tmp_path}/entries").count() == len(set(rows))


def blob(name):
    return hashlib.sha1(name.encode()).hexdigest()[2:]


def test_packs(spark, tmp_path):
    packs = f"{tmp_path}/packs"
    data = {"aa" + blob(x): f"content of {x}".encode() * 3 for x in "ABCDE"}
    names = dict(zip("ABCDE", data, strict=True))

    def write(letters):
        hashes = sorted(names[x] for x in letters)
        rows, at = [], 0
        for h in hashes:
            rows.append(("aa", 0, h, at, len(data[h]), bytearray(data[h])))
            at += len(data[h])
        return sinks.write_packs(spark.createDataFrame(rows, "prefix string, pack_no long, hash string, new_offset long, length long, content binary"), packs)

    first, second = write("ABC"), write("CDE")
    entries = sources.pack_entries(spark, packs)
    assert entries.count() == 6
    for most in (8 << 20, 60, 1):
        got = sources.read_objects(entries, packs, most).collect()
        assert len(got) == 6 and all(bytes(r["content"]) == data[r["hash"]] for r in got)
    with open(f"{packs}/aa/{first[0]['pack_id']}.pack", "rb") as f:
        assert hashlib.sha256(f.read()).hexdigest() == first[0]["pack_id"]
    reach = spark.createDataFrame([(names[x], s) for x, s in (("A", ""), ("C", "P"), ("E", ""))], ENTRY)
    stats = aggregates.compaction_stats(entries, reach).first()
    assert (stats["packs"], stats["kept"], stats["removed"]) == (2, 3, 2) and stats["reclaimed"] > 0
    plan = plans.compaction(entries, reach)
    assert plan.stale.count() == 2
    contents = sources.read_objects(plan.layout.select("prefix", "pack_id", "pack_no", "hash", "new_offset", "offset", "length"), packs)
    written = sinks.write_packs(contents, packs)
    assert len(sinks.drop_packs(plan.stale, written, packs)) == 2 and sources.pack_entries(spark, packs).count() == 9
    sinks.drop_packs(plan.stale, written, packs, really=True)
    left = sources.pack_entries(spark, packs)
    assert {r["hash"] for r in left.collect()} == {names[x] for x in "ACE"} and not [n for n in os.listdir(f"{packs}/aa") if "tmp" in n]
    # all reachable and in order already: nothing moves, nothing goes
    same = plans.compaction(left, reach)
    assert same.layout.count() == 0 and same.stale.count() == 0
    assert {tuple(r)[:3] for r in joins.resolve(reach, spark.createDataFrame([(names["A"], "")], ENTRY), left).collect()} == {(names["A"], "", "loose"), (names["C"], "P", "pack"), (names["E"], "", "pack")}
    assert plans.compaction(left, reach.limit(0)).stale.count() == 1
    assert second


def test_pack_merging(spark):
    rows = [(f"p{k}", "aa", "aa" + blob(f"{k % 5}-{i}"), i * 10, 10) for k in range(6) for i in range(3)]
    entries = spark.createDataFrame([*rows, ("q", "bb", "bb" + blob("x"), 0, 5)], PACK)
    plan = plans.merging(entries, above=3)
    assert plan.layout.count() == 15 and {r["prefix"] for r in plan.stale.collect()} == {"aa"}
    layout = plan.layout.orderBy("new_offset").collect()
    assert [r["new_offset"] for r in layout] == [10 * i for i in range(15)] and [r["hash"] for r in layout] == sorted(r["hash"] for r in layout)
    assert tuple(aggregates.store_totals(entries).first()) == (19, 185, 7, 6)


def test_index(spark):
    rows = [("aa00" + pad("1", 36), 1 << 32, 1024), ("aa55" + pad("2", 36), 7, 0), ("aaff" + pad("3", 36), (1 << 31) - 1, 9)]
    data = sinks.index_bytes(rows, bytes(20))
    table = lambda x: [tuple(r.values()) for r in sources.parse_index(x).to_pylist()]
    assert table(data) == rows and table(sinks.index_bytes([], bytes(20))) == []
    many = sorted((hashlib.sha1(str(i).encode()).hexdigest(), i * 3 if i % 7 else (1 << 31) + i, i) for i in range(5000))
    assert table(sinks.index_bytes(many, bytes(20))) == many
    for k in (0, 5, 1040, len(data) - 1):
        with pytest.raises(sources.BadIndex):
            sources.parse_index(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])
    with pytest.raises(ValueError):
        sinks.index_bytes(rows[::-1], bytes(20))
    with pytest.raises(ValueError):
        sinks.index_bytes([(pad("a"), 0, 1 << 32)], bytes(20))
    assert model.PACK_ENTRIES == (16 * 1024 * 1024 - 1072) // 28


def test_failed_pack_leaves_nothing(spark, tmp_path):
    rows = [("aa", 0, pad("a"), 0, 3, bytearray(b"abc")), ("aa", 0, pad("b"), 3, 9, bytearray(b"short"))]
    with pytest.raises(PySparkException):
        sinks.write_packs(spark.createDataFrame(rows, "prefix string, pack_no long, hash string, new_offset long, length long, content binary"), str(tmp_path))
    assert not [n for _, _, names in os.walk(tmp_path) for n in names]


def test_pack_store_refresh(spark, tmp_path):
    """Loaded indices are kept, vanished ones dropped, and corrupt ones and those without a pack are counted, not an end."""
    packs, schema = f"{tmp_path}/packs", "prefix string, pack_no long, hash string, new_offset long, length long, content binary"
    write = lambda text: sinks.write_packs(spark.createDataFrame([("aa", 0, "aa" + blob(text), 0, len(text), bytearray(text.encode()))], schema), packs)[0]["pack_id"]
    store = sources.PackStore(spark, packs)
    assert store.refresh() == {"kept": 0, "dropped": 0, "added": 0, "corrupt": 0, "orphans": 0}
    first, second = write("one"), write("two")
    assert store.refresh() == {"kept": 0, "dropped": 0, "added": 2, "corrupt": 0, "orphans": 0} and store.entries().count() == 2
    third = write("three")
    with open(f"{packs}/aa/broken.idx", "wb") as f, open(f"{packs}/aa/broken.pack", "wb"):
        f.write(b"no index")
    os.unlink(f"{packs}/aa/{second}.pack")
    for _ in range(2):
        got = store.refresh()
        assert {r["pack_id"] for r in store.entries().collect()} == {first, third}
    assert got == {"kept": 2, "dropped": 0, "added": 0, "corrupt": 1, "orphans": 1}
    assert sources.pack_entries(spark, packs, strict=False).count() == 2
    with pytest.raises(PySparkException, match="broken"):
        sources.pack_entries(spark, packs).collect()


@pytest.fixture
def upstream():
    """Serves /data/XX/rest of a dict, by http."""
    objects, seen = {}, []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            name = self.path.removeprefix("/data/").replace("/", "")
            found = objects.get(name)
            if found == "flaky" and seen.count(self.path) < 3:
                return self.send_error(503)
            if found is None:
                return self.send_error(404)
            body = b"after all" if found == "flaky" else found
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", objects, seen
    server.shutdown()


def test_http_reader(upstream):
    url, objects, seen = upstream
    objects |= {pad("a") + "C": b"catalog", pad("b"): "flaky"}
    read = sources.http_reader(url, timeout=5, per_second=1000)
    assert read(pad("a"), "C") == b"catalog" and read(pad("b"), "") == b"after all"
    seen.clear()
    with pytest.raises(sources.HttpError, match="404"):
        read(pad("c"), "")
    assert len(seen) == 1  # a client's error is not tried again
    with pytest.raises(sources.HttpError):
        sources.http_reader("http://127.0.0.1:9", timeout=1, tries=2)(pad("a"), "")


def test_mirror(spark, tmp_path, upstream):
    one = lambda *h: spark.createDataFrame([(x,) for x in h], "hash string")
    url, objects, _ = upstream
    root, below, large = named("root"), named("below"), named("large")
    edges = spark.createDataFrame([(root, below)], "parent string, child string")
    small = [named(f"small {k}") for k in range(5)]
    refs = spark.createDataFrame([(root, small[0], ""), (root, large, "P"), (root, named("there"), ""), *((below, h, "") for h in small), (below, small[1], "P")], "catalog_hash string, hash string, suffix string")
    contents = lambda c: refs.join(c.withColumnRenamed("hash", "catalog_hash"), "catalog_hash", "left_semi").select("hash", "suffix")
    data, packs, state = (f"{tmp_path}/{x}" for x in ("data", "packs", "state"))
    loose = spark.createDataFrame([(named("there"), "")], ENTRY)
    objects |= {root + "C": b"r", below + "C": b"b", large + "P": b"y" * 300_000, small[1] + "P": b"small 1", **{h: f"small {k}".encode() for k, h in enumerate(small) if k != 3}}
    read = sources.http_reader(url, timeout=5, tries=1)
    here = lambda: sources.pack_entries(spark, packs)
    run = lambda: streaming.mirror(spark, one(root), marking.by_edges(edges), contents, read, loose.unionByName(sources.loose_objects(spark, data).select("hash", "suffix")), here(), data, packs, state, per_pack=3)
    out = run()
    assert out["catalogs"] == 2 and out["discovered"] == 8 and out["skipped"] == 1 and out["failed"] == 1 and out["loose"] == 1 and out["packed"] == 5 and not os.path.exists(state)
    assert out["bytes"] == 300_000 + 5 * 7 and out["packs"] == len([n for _, _, names in os.walk(packs) for n in names if n.endswith(".pack")])
    assert os.path.getsize(f"{data}/{large[:2]}/{large[2:]}P") == 300_000
    # what is small is in packs and nowhere else
    assert {r["hash"] for r in here().collect()} == {h for k, h in enumerate(small) if k != 3}
    assert {r["name"] for r in sources.loose_objects(spark, data).collect()} == {root + "C", below + "C", large + "P"}
    for r in sources.read_objects(here(), packs).collect():
        assert bytes(r["content"]) == f"small {small.index(r['hash'])}".encode()
    objects[small[3]] = b"small 3"
    again = run()
    assert again["failed"] == 0 and again["packed"] == 1 and again["skipped"] == 7
    assert {r["hash"] for r in sources.processed_catalogs(spark, state).collect()} == {root, below}
    assert plans.fetch_plan(contents(one(root, below)), loose.unionByName(sources.loose_objects(spark, data).select("hash", "suffix")), here()).count() == 0
    assert run()["catalogs"] == 0
    # without a state, catalogs that are stored count as processed
    out = streaming.mirror(spark, one(root), marking.by_edges(edges), contents, read, sources.loose_objects(spark, data).select("hash", "suffix"), here(), data, packs, None)
    assert out["catalogs"] == 0 and out["discovered"] == 0


def test_state_survives_a_crash(spark, tmp_path):
    """A version that was not finished doesn't count, whatever it holds; a plain file of lines is a state too."""
    state = f"{tmp_path}/state"
    hashes = lambda *h: spark.createDataFrame([(x,) for x in h], "hash string")
    held = lambda: {r["hash"] for r in sources.processed_catalogs(spark, state).collect()}
    assert held() == set()
    os.makedirs(f"{state}/processed-000000000001")
    assert held() == set()
    sinks.save_processed(hashes("b", "a", "b"), state)
    assert held() == {"a", "b"}
    os.makedirs(f"{state}/processed-000000000002")
    with open(f"{state}/processed-000000000002/part-0", "w") as f:
        f.write("half\n")
    assert held() == {"a", "b"}
    sinks.save_processed(hashes("c"), state)
    assert held() == {"c"} and len(sources.state_versions(spark, state)) == 1
    with open(f"{tmp_path}/plain", "w") as f:
        f.write(" x \n\ny\n")
    assert {r["hash"] for r in sources.processed_catalogs(spark, f"{tmp_path}/plain").collect()} == {"x", "y"}


def test_server_cycle(spark, tmp_path):
    """Catalog files to new packs: unreachable entries and second copies go, loose objects go by hash, the status has the time."""
    data, packs = f"{tmp_path}/data", f"{tmp_path}/packs"
    os.makedirs(data)
    contents = {"aa" + blob(x): x.encode() * 5 for x in ("kept one", "kept two", "gone", "loose kept", "loose gone")}
    kept1, kept2, gone, loose1, loose2 = contents
    root, below = named("root"), named("below")
    catalog_db(f"{data}/{root[:2]}/{root[2:]}C", [(1, 1, kept1, 4), (1, 2, loose1, 4)], nested=[("/x", below)])
    catalog_db(f"{data}/{below[:2]}/{below[2:]}C", [(1, 1, kept2, 4), (1, 2, kept1, 4)])
    schema = "prefix string, pack_no long, hash string, new_offset long, length long, content binary"
    for some in ((kept1, gone), (kept1, kept2, gone)):
        at, rows = 0, []
        for h in sorted(some):
            rows.append(("aa", 0, h, at, len(contents[h]), bytearray(contents[h])))
            at += len(contents[h])
        sinks.write_packs(spark.createDataFrame(rows, schema), packs)
    sinks.write_loose(spark.createDataFrame([(h, "", bytearray(contents[h])) for h in (loose1, loose2)], "hash string, suffix string, content binary"), data)
    read = sources.file_reader(data)
    cycle = plans.server_cycle(spark.createDataFrame([(root,)], "hash string"), lambda f: sources.catalog_refs(sources.catalog_files(f, read)), sources.pack_entries(spark, packs), sources.loose_objects(spark, data))
    stats = cycle.stats.first().asDict()
    assert stats["catalogs"] == 2 and stats["entries"] == 6 and stats["unique_entries"] == 5 and (stats["packs"], stats["kept"], stats["removed"]) == (2, 2, 1)
    assert (stats["loose_kept"], stats["loose_deleted"], stats["bytes_freed"]) == (3, 1, len(contents[loose2]))
    assert sinks.apply_cycle(cycle, packs) == {"packs_written": 0, "packs_dropped": 2, "loose_deleted": 1} and sources.pack_entries(spark, packs).count() == 5
    status = f"{tmp_path}/status.json"
    assert sinks.apply_cycle(cycle, packs, status, really=True) == {"packs_written": 1, "packs_dropped": 2, "loose_deleted": 1}
    assert {r["hash"]: bytes(r["content"]) for r in sources.read_objects(sources.pack_entries(spark, packs), packs).collect()} == {h: contents[h] for h in (kept1, kept2)}
    assert {r["hash"] for r in sources.loose_objects(spark, data).collect()} == {root, below, loose1} and "UTC" in open(status).read()


def test_report_and_counts(spark):
    one = lambda *h: spark.createDataFrame([(x,) for x in h], "hash string")
    edges, refs = graph(spark, [("r", "a"), ("r", "b"), ("a", "b")], [("a", "x"), ("b", "x"), ("b", "y")])
    visited = marking.mark(one("r"), edges)
    assert marking.counts(one("r"), visited, edges, refs, failed=one("b")).first().asDict() == {"started": 3, "processed": 2, "skipped": 1, "emitted": 7}
    stored = spark.createDataFrame([("x", "", 5, "x"), ("z", "", 2048, "z"), ("late", "", 1, "l")], ENTRY + ", length long, prefix string")
    bag = marking.emitted(visited, one("r"), edges, refs)
    phases = {}
    sweep = sinks.timed(phases, "sweep", lambda: plans.two_pass(stored, bag, spark.createDataFrame([("late", "")], ENTRY)))
    row = plans.report(stored, bag, sweep, visited, trees=1, phases=phases).first().asDict()
    assert row.pop("seconds_sweep") > 0
    assert row == {"trees": 1, "catalogs": 3, "entries": 7, "unique_entries": 5, "duplicate_entries": 2, "prefixes": 3, "checked": 3, "retained": 1, "candidates": 2, "protected": 1, "deleted": 1, "percent": 33.3333, "bytes": 2048, "freed": "2.0 KB", "errors": 0}


def test_repositories(spark):
    """Stores of several repositories in one table stay apart."""
    stored = lambda *h: spark.createDataFrame([(x, "", 10) for x in h], ENTRY + ", length long")
    reach = lambda *h: spark.createDataFrame([(x, "") for x in h], ENTRY)
    both = joins.across({"one": stored("a", "b"), "two": stored("a", "c")})
    marks = joins.across({"one": reach("a"), "two": reach("c")})
    sweep = plans.two_pass(both, marks, joins.across({"two": reach("a")}), joins.IN_REPOSITORY)
    assert {(r["repository"], r["hash"]) for r in sweep.candidates.collect()} == {("one", "b"), ("two", "a")}
    assert {(r["repository"], r["hash"]) for r in sweep.to_delete.collect()} == {("one", "b")}
    assert {tuple(r) for r in aggregates.by_repository(both).collect()} == {("one", 2, 20), ("two", 2, 20)}
    with pytest.raises(ValueError):
        joins.across({})


def test_fresh_objects(spark, tmp_path):
    """A stream without what came before; its state is kept between runs."""
    schema, out = "hash string, suffix string, ts timestamp", []

    def run(k, rows):
        spark.createDataFrame(rows, "hash string, suffix string, ts string").selectExpr("hash", "suffix", "CAST(ts AS timestamp) AS ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events = streaming.fresh_objects(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        events.writeStream.foreachBatch(lambda df, _: out.extend((r["hash"], r["suffix"]) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)

    run(0, [("a", "", "2024-01-01 00:00:00"), ("a", "", "2024-01-01 00:10:00"), ("a", "C", "2024-01-01 00:10:00")])
    assert sorted(out) == [("a", ""), ("a", "C")]
    run(1, [("a", "", "2024-01-01 00:20:00"), ("b", "", "2024-01-01 00:20:00")])
    assert sorted(out) == [("a", ""), ("a", "C"), ("b", "")]


def test_watch(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    for name, text in (("a", "Caa\nS1"), ("b", "Cbb\nGno"), ("c", "Nnone")):
        with open(f"{tmp_path}/in/{name}", "w") as f:
            f.write(text)
    seen = []
    for _ in range(2):
        streaming.watch(spark, f"{tmp_path}/in", f"{tmp_path}/state", lambda m, k: seen.append(m["root"])).awaitTermination(60)
    assert seen == ["aa"]


def test_status(tmp_path):
    path = f"{tmp_path}/status.json"
    sinks.write_status(path, last_gc="a", state="idle")
    assert sinks.write_status(path, last_gc="b") == {"last_gc": "b", "state": "idle"}
