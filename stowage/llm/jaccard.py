"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A document is the sorted array of the hashes of its distinct word shingles. Two documents link when the Jaccard
similarity of their sets is `percent` or more; every such pair counts, however frequent its shingles.

1. Equal sets are one node, so that copies cost nothing more.
2. Sizes are banded so that linked sets lie in one band or two neighbours; a tile is a band and the top of the one
   below. In a tile linked sets differ in at most d shingles. The shingles are dealt into k = d + r parts by their
   hash; linked sets agree in r parts at least. A part's checksum is a key. A set of n shingles differs from linked
   ones in (1 / percent - 1) * n at most. With more parts in use than that, it agrees with each in one of these, and
   its empty parts, which a share of all sets has in common, are no keys.
3. Keys that one set has alone lead nowhere; a set of whose keys fewer than r are shared links with none. The shared
   keys are few; a bitmap of them (16 bits for each, up to `key_bits`: it only spares work) drops the others before
   they are shuffled.
   Of a set's keys the d + 1 rarest suffice to meet (prefix filter), so that the most frequent ones, those of passages that
   many documents share, are not used.
4. Nodes of a key are compared with its smallest node first. What is verified becomes components; of the keys whose
   nodes are still in different components every pair is compared, in blocks. The sizes and the bit counts of the
   bitmaps' difference bound the overlap from above; the pairs that are left are verified by intersecting the arrays.
5. Components of the verified links.

Nothing is gathered by the driver but counts; the ids of candidate documents are broadcast up to `broadcast_ids`
of them, and joined by a shuffle beyond.

Null and wordless texts have no shingles, link with nothing and are their own component. Repeated rows get equal
results. A null doc_id gets the component of equal sets, if they have one. components() needs a doc_id that tells
texts apart (rows of one id with different sets are linked through either); keep_one() doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.components import connected
from stowage.llm.util import bitmap, has_bit, slices
from stowage.session import materialise

CACHED_WORDS = 150_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct hashes of the n-word shingles of a text; of fewer words the whole sequence is one."""

    def __init__(self, n: int):
        self.n, self.words = n, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").translate(LOWER).split()  # bytes.split() splits at 09 to 0D and 20 alone
        if not words:
            return np.zeros(0, "uint64")
        known, digest = self.words, xxhash.xxh3_64_intdigest
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = digest(w)
        h = np.fromiter(map(known.__getitem__, words), "uint64", len(words))
        m = min(self.n, len(h))
        out = np.full(len(h) - m + 1, m, "uint64")
        for k in range(m):
            out = mix(out * M1 + h[k : k + len(out)])
        return np.unique(out)


@cache
def bands(percent: int, upto: int) -> tuple[int, ...]:
    """Smallest sizes of the bands, up to two beyond `upto`; each band reaches as far as a linked set can, and 3 : 5 at least."""
    low, ratio = [1], max(167, -(-10000 // percent))
    while low[-1] <= upto or len(low) < 3 or low[-2] <= upto:
        low.append(max(low[-1] + 1, -(-low[-1] * ratio // 100)))
    return tuple(low)


def shape(low: int, percent: int) -> tuple[int, int, int]:
    """Of a tile whose sets are smaller than `low` of the next band: d, k and bits."""
    largest = low - 1
    d = (100 - percent) * 2 * largest // (100 + percent)
    return d, d + max(1, d // 10), min(4096, max(64, 1 << (largest - 1).bit_length()))


def keys(s: np.ndarray, tile: int, d: int, k: int, percent: int) -> tuple[int, np.ndarray]:
    """How many keys may differ from a linked set's, and the keys: checksums of those of the k parts that have shingles.

    A linked set differs in d shingles at most, and has p - d of the p keys. A set without more than d keys gets those
    of empty parts too, all of which count (d is one less than their number), so that two such sets meet as well.
    48 bits: two that are equal by chance, be it those of two tiles, are a meeting more: a key's nodes are told apart by tile, and pairs are verified.
    """
    part = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # grows with s, which is sorted
    edges = np.searchsorted(part, np.arange(k + 1, dtype="uint64"))
    sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum(mix(s), dtype="uint64")])
    out = (mix((sums[edges[1:]] - sums[edges[:-1]]) + mix(np.arange(k, dtype="uint64") + np.uint64(tile << 32))) >> np.uint64(16)).view("int64")
    d, used = min(d, (100 - percent) * len(s) // percent), edges[1:] > edges[:-1]
    return (d, out[used]) if used.sum() > d else (k - 1, out)


def signature(s: np.ndarray, bits: int) -> bytes:
    """Bit i: whether an odd number of hashes ends in i; sets that differ in x shingles differ in x bits at most."""
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype("int64"), minlength=bits) & 1).astype("uint8").tobytes()


def tiles(n: int, percent: int) -> Iterator[tuple[int, int, int, int]]:
    """Tiles of a set of n shingles in which unequal sets can link: tile, d, k, bits."""
    low = bands(percent, 1 << max(8, n.bit_length() + 1))
    own = int(np.searchsorted(low, n, "right")) - 1
    for tile in (own, own + 1):
        if tile == own or 100 * n >= percent * low[tile]:
            d, k, bits = shape(low[tile + 1], percent)
            if d and (100 - percent) * n >= percent:
                yield tile, d, k, bits


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits as two longs."""
    hi, lo = divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64)
    return hi - (hi >> 63 << 64), lo - (lo >> 63 << 64)


def table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def set_keys(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """hi and keys of each tile of each set of docs (i, t)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1):
                if len(s := shingles(text.as_py())):
                    hi, _ = set_hash(s)
                    rows += [(hi, keys(s, tile, d, k, percent)[1]) for tile, d, k, _ in tiles(len(s), percent)]
            yield table(rows, ["hi", "keys"], [pa.int64(), pa.list_(pa.int64())])

    return docs.mapInArrow(sketch, "hi long, keys array<bigint>")


SKETCH = "doc_id long, n long, hi long, lo long, own boolean, tile int, d int, k int, keys array<bigint>, bits binary"


def sketches(docs: DataFrame, shingle: int, percent: int, shared: np.ndarray) -> DataFrame:
    """Of docs (i, t): a row for each document (own), and one for each tile in which it can link, with bitmap and shared keys.

    shared: bitmap of the keys that two different sets have. A set with fewer than k - d of them among its k keys of a tile links with none there.
    """
    names = [x.split()[0] for x in SKETCH.split(", ")]
    types = [pa.int64()] * 4 + [pa.bool_()] + [pa.int32()] * 3 + [pa.list_(pa.int64()), pa.binary()]
    sent = docs.sparkSession.sparkContext.broadcast(shared)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, words = Shingles(shingle), sent.value
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text.as_py())
                hi, lo = set_hash(s) if len(s) else (None, None)
                rows.append((doc_id, len(s), hi, lo, True, None, None, None, None, None))
                for tile, d, k, bits in tiles(len(s), percent) if len(s) and doc_id is not None else ():
                    d, found = keys(s, tile, d, k, percent)
                    k, found = len(found), found[has_bit(words, found)]
                    if len(found) >= k - d:
                        rows.append((doc_id, len(s), hi, lo, False, tile, d, k, found, signature(s, bits)))
            yield table(rows, names, types)

    return docs.mapInArrow(sketch, SKETCH)


def possible(n1, n2, differ, percent: int):
    """Whether sets of sizes n1 and n2 whose bitmaps differ in so many bits can link: their overlap is at most half the rest."""
    overlap = (n1 + n2 - differ) // 2
    return 100 * overlap >= percent * (n1 + n2 - overlap)


def sized(df: DataFrame, ids: DataFrame, key: str, how: str, broadcast_ids: int) -> DataFrame:
    """Join with ids (one column: key), broadcast if there are at most broadcast_ids of them."""
    return df.join(F.broadcast(ids) if ids.count() <= broadcast_ids else ids, key, how)


def verified(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, broadcast_ids: int) -> DataFrame:
    """Those of pairs (a, b) whose sets link, by the intersection of their sorted arrays."""
    ids = materialise(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct())
    few = sized(docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("binary").alias("t")), ids, "node", "left_semi", broadcast_ids)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["node", "s"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "uint64"), np.frombuffer(y.as_buffer(), "uint64")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    sets = materialise(few.mapInArrow(hashed, "node long, s binary").dropDuplicates())
    sets_a, sets_b = sets.select(F.col("node").alias("a"), F.col("s").alias("x")), sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    joined = pairs.join(sets_a, "a").join(sets_b, "b").select("a", "b", "x", "y")
    return materialise(joined.mapInArrow(linked, "a long, b long").distinct())


def hub_pairs(met: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs of each node with the smallest node of its key and tile, if the bitmaps let them link. met: key, tile, node; sizes: node, tile, n, bits."""
    hubs = met.groupBy("key", "tile").agg(F.min("node").alias("hub"))
    near = met.join(hubs, ["key", "tile"]).where(F.col("node") != F.col("hub")).select("tile", F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    near = near.join(sizes.select("tile", F.col("node").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("x")), ["tile", "a"])
    near = near.join(sizes.select("tile", F.col("node").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("y")), ["tile", "b"])
    near = near.select("a", "b", "n1", "n2", "x", "y")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            differ = [int(np.bitwise_count(np.frombuffer(x.as_buffer(), "uint64") ^ np.frombuffer(y.as_buffer(), "uint64")).sum()) for x, y in zip(get["x"], get["y"], strict=True)]
            good = possible(get["n1"].to_numpy(), get["n2"].to_numpy(), np.array(differ, "int64"), percent)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return near.mapInArrow(bounded, "a long, b long").distinct()


def tile_pairs(met: DataFrame, sizes: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs of nodes of one key and tile and of different components that the sizes and bitmaps let link.

    met: key, tile, node, component; sizes: node, tile, n, bits. A key with more than `block` nodes is worked on in pairs of blocks.
    Bitmaps are as long as their tile says, and keys of two tiles can be equal by chance, so that a group is of one tile.
    """
    mixed = met.groupBy("key", "tile").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 != c2")
    df = met.join(mixed.select("key", "tile", F.ceil(F.col("m") / block).cast("int").alias("blocks")), ["key", "tile"]).join(sizes, ["node", "tile"])
    df = df.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    df = df.select("key", "tile", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "n", "node", "component", "bits")
    df = df.repartition("key", "tile", "i", "j").sortWithinPartitions("key", "tile", "i", "j", "n", "node")

    def compare(rows: list[tuple]) -> list[tuple[int, int]]:
        mine, n, node, component = (np.array(c, "int64") for c in zip(*(r[4:8] for r in rows), strict=True))
        bits = np.frombuffer(b"".join(r[8] for r in rows), "uint64").reshape(len(rows), -1)
        apart, out = rows[0][2] != rows[0][3], []
        ends = np.searchsorted(n, 100 * n // percent, "right")  # sorted by size: no larger set can link
        for a in range(len(rows) - 1):
            to = slice(a + 1, int(ends[a]))
            good = component[to] != component[a]
            if apart:
                good &= mine[to] != mine[a]
            if good.any():
                good &= possible(n[a], n[to], np.bitwise_count(bits[to] ^ bits[a]).sum(1, dtype="int64"), percent)
                out += [(int(min(node[a], node[b])), int(max(node[a], node[b]))) for b in np.flatnonzero(good) + a + 1]
        return out

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:4] != group[0][:4]:
                    out += compare(group)
                    group = []
                group.append(row)
            out = sorted(set(out))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        out = compare(group) if group else []
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return df.mapInArrow(sweep, "a long, b long").distinct()


def shared_keys(sets: DataFrame) -> DataFrame:
    """key and c, the rows that have it, of the keys that two different sets have."""
    counted = sets.select("hi", F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("hi").alias("x"), F.max("hi").alias("y"))
    return counted.where("x != y").select("key", "c")


def key_bitmap(shared: DataFrame, most_bits: int) -> np.ndarray:
    """A bitmap of the shared keys, as large as their number asks for; the driver gathers bits / 64 words at most."""
    return bitmap(shared, "key", min(most_bits, 1 << max(16, (16 * shared.count()).bit_length())))


def meetings(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """key, tile, node for the shared keys that are among a node's d + 1 rarest."""
    records = nodes.select("node", "tile", (F.col("d") + 1 - F.col("k")).alias("room"), F.explode("keys").alias("key"))
    df = records.join(shared, "key").groupBy("node", "tile").agg(F.first("room").alias("room"), F.sort_array(F.collect_list(F.struct("c", "key"))).alias("found"))
    room = F.col("room") + F.size("found")  # keys of one set alone are the rarest
    return df.where(room > 0).select(F.explode(F.slice("found", 1, room)).alias("f"), "tile", "node").select(F.col("f.key").alias("key"), "tile", "node")


def prepared(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, key_bits: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows of documents (doc_id, n, hi, lo), classes of equal sets (hi, lo, node: the smallest doc_id), meetings of nodes, and sizes of nodes."""
    few = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t"))
    shared = materialise(shared_keys(set_keys(few, shingle, percent)))
    all_rows = materialise(sketches(few, shingle, percent, key_bitmap(shared, key_bits)))
    own = all_rows.where("own").select("doc_id", "n", "hi", "lo")
    classes = materialise(own.where(F.col("n") > 0).groupBy("hi", "lo").agg(F.min("doc_id").alias("node")))
    named = classes.where(F.col("node").isNotNull()).select("node", F.col("hi").alias("h"), F.col("lo").alias("l"))
    rows = all_rows.where("not own").withColumnRenamed("doc_id", "node").join(named, "node").where("hi = h and lo = l")
    rows = rows.select("node", "n", "tile", "d", "k", "keys", "bits").dropDuplicates(["node", "tile"])
    rows = materialise(rows)
    return own, classes, materialise(meetings(rows, shared)), rows.select("node", "tile", "n", "bits")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90, block: int = 2000, broadcast_ids: int = 1_000_000, key_bits: int = 1 << 28) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each document."""
    own, classes, met, sizes = prepared(docs, id_col, text_col, shingle, percent, key_bits)
    check = lambda pairs: verified(docs, materialise(pairs), id_col, text_col, shingle, percent, broadcast_ids)
    links = check(hub_pairs(met, sizes, percent))
    known = materialise(connected(links))
    labelled = met.join(known, "node", "left").select("key", "tile", "node", F.coalesce("component", "node").alias("component"))
    more = check(tile_pairs(labelled, sizes, percent, block))
    # known components stand for their links
    known = connected(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))
    lone = classes.join(known, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component"))
    out = own.join(lone, ["hi", "lo"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90, block: int = 2000, broadcast_ids: int = 1_000_000, key_bits: int = 1 << 28) -> tuple[DataFrame, DataFrame]:
    """All links (a, b) between classes of equal sets, named by their smallest doc_id, and per document doc_id, class_id and n_links.

    n_links counts the other classes that link with a document's. components() spares pairs that are connected
    already; here each pair of classes that meet is compared, which is quadratic in a group of near copies.
    """
    own, classes, met, sizes = prepared(docs, id_col, text_col, shingle, percent, key_bits)
    pairs = materialise(tile_pairs(met.withColumn("component", F.col("node")), sizes, percent, block))
    found = verified(docs, pairs, id_col, text_col, shingle, percent, broadcast_ids)
    ends = found.select(F.col("a").alias("node")).unionAll(found.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    counted = classes.join(ends, "node", "left")
    members = own.select("doc_id", "hi", "lo").join(counted, ["hi", "lo"], "left")
    return found, members.select("doc_id", F.coalesce("node", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, broadcast_ids: int = 1_000_000) -> DataFrame:
    """One document of each component stays: the smallest doc_id. Of rows with one id and text one stays.

    Where rows of one id have different texts, or no id, a hash of id and text above all other ids tells them apart:
    each is linked for itself, and stays if nothing with a smaller id links with it.
    """
    names = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("i"), F.xxhash64(F.length(text), text).alias("h"))
    each = materialise(plain.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).where("n > 1 or i is null").select("i", "n", "low", "high"))
    mixed = each.where("low != high or i is null").select("i")
    own = F.xxhash64(F.col("doc_id").cast("long"), F.length(text), text).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    plain = docs.toDF(*(f"__{k}" for k in range(len(names))))
    if mixed.isEmpty():
        keyed = plain.withColumn("node", F.col(f"__{names.index('doc_id')}").cast("long"))
    else:
        few = mixed.where("i is not null").withColumnRenamed("i", "doc_id").withColumn("mixed", F.lit(True))
        keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("own"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
        keys = sized(keys, few, "doc_id", "left", broadcast_ids)
        keyed = keys.select(*(F.col("row").getField(c).alias(f"__{k}") for k, c in enumerate(names)), F.when(F.col("mixed") | F.col("doc_id").isNull(), F.col("own")).otherwise(F.col("doc_id")).alias("node"))
    found = components(keyed, "node", f"__{names.index('text')}", shingle=shingle, percent=percent, broadcast_ids=broadcast_ids)
    found = materialise(found.select(F.col("doc_id").alias("node"), "component_id"))
    dropped = found.where(F.col("node") != F.col("component_id")).select("node").distinct()
    kept = sized(keyed, dropped, "node", "left_anti", broadcast_ids)
    if not each.isEmpty():
        twice = materialise(found.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"))
        kept = sized(kept, twice, "node", "left_anti", broadcast_ids).unionByName(sized(kept, twice, "node", "left_semi", broadcast_ids).dropDuplicates(["node"]))
    return kept.drop("node").toDF(*names)
