"""Benchmark decontamination: spaced seeds.

Masks choose positions of a window of words and ignore the rest. They follow from the overlap that is asked for, so
that each such overlap has a hit, wherever its substituted words are: e changes leave e + 1 runs of equal words, and
the longest run has its share of them at least. Seeds of all benchmark items are hashed into a table; each document's
windows are hashed by the same masks and looked up. Around each hit the item and the document are aligned, and the
longest stretch with a share of equal words of `similarity` or more is verified word by word.

A benchmark of up to `broadcast_words` words is sent to executors, and its documents pass in one step. Beyond that
its seeds are a table: a bitmap of them (of a size that follows from their number, up to `bitmap_bits`; it only spares
work) picks the documents' windows that can meet one, these are joined with the seeds by a shuffle on their hash, and
the pairs found are verified with the texts of just these documents and items. Results are the same.

Words are runs of letters and digits in lower case. Null and wordless texts and items match nothing. Items with
equal words are searched once and reported each, repeated rows of an item once; repeated documents are reported each.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.util import bitmap, has_bit
from stowage.session import materialise

WORD = re.compile(r"[^\W_]+")


def item_words(text: str | None) -> tuple[str, ...]:
    return tuple(WORD.findall((text or "").lower()))


@functools.cache
def covering_masks(n: int, similarity: float, least_words: int) -> tuple[str, ...]:
    """Masks of which one hits each overlap of an item of n words: least_words, or all n if fewer, `similarity` equal.

    An overlap begins and ends with equal words. Where all of its runs can only have r words each, two of them
    around one change are a seed, and r + 1 words in a row are enough elsewhere.
    """
    runs = {}  # least longest run: whether it takes runs of just that length
    for m in range(min(n, least_words), n + 1):
        changed = math.floor((1 - similarity) * m + 1e-9)
        r = max(1, -(-(m - changed) // (changed + 1)))
        runs[r] = runs.get(r, True) and changed > 0 and m - changed == r * (changed + 1)
    r = min(runs)
    return ("1" * (r + 1), "1" * r + "0" + "1" * r) if runs[r] else ("1" * r,)


def factors(mask: str) -> np.ndarray:
    """One odd 64-bit factor for each position that counts, the same in every run."""
    state = np.random.Generator(np.random.PCG64(int("1" + mask, 2))).integers(0, 1 << 63, len(mask), dtype="uint64")
    return (state << np.uint64(1)) | np.uint64(1)


def seeds(ids: np.ndarray, mask: str, by: np.ndarray) -> np.ndarray:
    n = len(ids) - len(mask) + 1
    total = np.zeros(max(n, 0), "uint64")
    if n > 0:
        for k, bit in enumerate(mask):
            if bit == "1":
                total += ids[k : k + n] * by[k]
    return total


def longest_stretch(equal: np.ndarray, share: float) -> tuple[int, int]:
    """Start and end of the longest run of positions of which `share` or more are equal; it begins and ends with equal ones."""
    score = np.concatenate([[0.0], np.cumsum(equal - share)])
    lows = np.minimum.accumulate(np.where(np.append(equal, False), score, np.inf))  # over the starts that are equal
    best = (0, 0)
    for end in range(len(equal), 0, -1):
        if end <= best[1] - best[0]:
            break
        if equal[end - 1]:
            start = int(np.searchsorted(-lows[:end], -(score[end] + 1e-9)))  # the first that leaves 0 or more
            if start < end and end - start > best[1] - best[0]:
                best = (start, end)
    return best


def best_overlap(item: np.ndarray, ids: np.ndarray, shifts, similarity: float, least_words: int) -> tuple[int, int, int] | None:
    """First word in the text, words and equal words of the longest verified overlap of an item at any of the shifts."""
    best = None
    for shift in shifts:
        low, high = max(0, -shift), min(len(item), len(ids) - shift)
        equal = item[low:high] == ids[low + shift : high + shift]
        if equal.sum() < similarity * min(len(item), least_words) - 1e-9:
            continue
        start, end = longest_stretch(equal, similarity)
        if end - start >= min(len(item), least_words):
            found = (end - start, int(equal[start:end].sum()), -(low + shift + start))
            best = found if best is None else max(best, found)
    return best and (-best[2], best[0], best[1])


class Index:
    """Seeds of benchmark items."""

    def __init__(self, items: list[tuple[int, tuple[str, ...]]], similarity: float, least_words: int):
        self.similarity, self.least = similarity, least_words
        self.vocabulary: dict[str, int] = {}
        self.items, place = [], {}
        for item_id, ws in sorted(set(items), key=lambda x: (x[0] is None, x[0], x[1])):
            if ws and ws not in place:
                place[ws] = len(self.items)
                self.items.append(([], np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], "uint64")))
            if ws:
                self.items[place[ws]][0].append(item_id)
        self.table: dict[str, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, ids) in enumerate(self.items):
            for mask in covering_masks(len(ids), similarity, least_words):
                for at, seed in enumerate(seeds(ids, mask, factors(mask)).tolist()):
                    self.table[mask][seed].append((k, at))
        self.table = {m: dict(t) for m, t in self.table.items()}
        self.bits = max(16, (64 * max([1, *map(len, self.table.values())])).bit_length())
        self.maybe = {}
        for mask, t in self.table.items():
            self.maybe[mask] = (factors(mask), np.zeros(1 << self.bits, bool))
            self.maybe[mask][1][np.fromiter(t, "uint64", len(t)) >> np.uint64(64 - self.bits)] = True

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """Verified overlaps: (item_id, first word in the text, words, equal words), the longest of each item."""
        get = self.vocabulary.get
        found = WORD.findall(text.lower())
        ids = np.fromiter((get(w, 0) for w in found), "uint64", len(found))
        shifts = defaultdict(set)
        for mask, (by, maybe) in self.maybe.items():
            got = seeds(ids, mask, by)
            for at in np.flatnonzero(maybe[got >> np.uint64(64 - self.bits)]).tolist():
                for k, start in self.table[mask].get(int(got[at]), ()):
                    shifts[k].add(at - start)
        best = {k: best_overlap(self.items[k][1], ids, s, self.similarity, self.least) for k, s in shifts.items()}
        return sorted(((i, *b) for k, b in best.items() if b for i in self.items[k][0]), key=lambda x: (x[0] is None, x))


def word_ids(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text."""
    found = WORD.findall(text.lower())
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found), "uint64", len(found))


def text_hash(column) -> Column:
    return F.sha2(F.coalesce(column, F.lit("")), 256)


def searched(docs: DataFrame, benchmark: DataFrame, similarity: float, least_words: int, bitmap_bits: int) -> DataFrame:
    """text (its hash), item_id, first_word, n_words, n_equal of docs (i, t), by joins of tables."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(item_words(t.as_py())) for t in batch.column(1)], pa.string())], ["i", "u"])

    items = benchmark.select("i", "t").mapInArrow(plain, "i long, u string").where("u != ''").distinct()
    items = materialise(items.withColumn("item", text_hash(F.col("u"))))
    masks = "mask string, seed long, item string, at int"

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = word_ids(text.as_py())
                for mask in covering_masks(len(ids), similarity, least_words):
                    got = seeds(ids, mask, factors(mask)).view("int64")
                    yield pa.RecordBatch.from_arrays([pa.array([mask] * len(got)), pa.array(got), pa.array([item] * len(got)), pa.array(range(len(got)), pa.int32())], ["mask", "seed", "item", "at"])

    table = materialise(items.select("item", "u").dropDuplicates(["item"]).mapInArrow(item_seeds, masks))
    used = sorted(r["mask"] for r in table.select("mask").distinct().collect())  # a few for each length of overlap
    bits = min(bitmap_bits, 1 << max(16, (16 * table.count()).bit_length()))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(table.select("seed"), "seed", bits))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, by = sent.value, {m: factors(m) for m in used}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = word_ids(text.as_py() or "")
                for mask in used:
                    got = seeds(ids, mask, by[mask])
                    some = np.flatnonzero(has_bit(words, got))
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(some)), pa.array([mask] * len(some)), pa.array(got[some].view("int64")), pa.array(some.astype("int32"))], ["text", "mask", "seed", "at"])

    keyed = docs.select(text_hash(F.col("t")).alias("text"), "t")
    met = keyed.mapInArrow(hits, "text string, mask string, seed long, at int").join(table.withColumnRenamed("at", "start"), ["mask", "seed"])
    pairs = materialise(met.select("text", "item", (F.col("at") - F.col("start")).alias("shift")).distinct())
    # the texts of the pairs' documents and items alone; a pair's shifts are as many as the item is long
    texts = keyed.join(pairs.select("text").distinct(), "text", "left_semi").dropDuplicates(["text"])
    few = pairs.groupBy("text", "item").agg(F.collect_set("shift").alias("shifts")).join(texts, "text")
    few = few.join(items.select("item", "u").dropDuplicates(["item"]), "item").select("text", "item", "shifts", "t", "u")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, item, shifts, t, u in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if found := best_overlap(word_ids(u), word_ids(t), shifts, similarity, least_words):
                    rows.append((text, item, *found))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string()] * 2 + [pa.int64()] * 3)], ["text", "item", "first_word", "n_words", "n_equal"])

    verified = few.mapInArrow(verify, "text string, item string, first_word long, n_words long, n_equal long")
    return materialise(verified.join(items.select("item", F.col("i").alias("item_id")), "item").drop("item"))


def small_index(benchmark: DataFrame, similarity: float, least_words: int, broadcast_words: int) -> Index | None:
    """An index of benchmark (i, t), if it has no more words than that; the driver gathers no more."""
    size = benchmark.agg(F.sum(F.regexp_count("t", F.lit(r"[\p{L}\p{N}]+")))).first()[0] or 0
    if size > broadcast_words:
        return None
    return Index([(r["i"], item_words(r["t"])) for r in benchmark.toLocalIterator()], similarity, least_words)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, least_words: int = 12, broadcast_words: int = 2_000_000, bitmap_bits: int = 1 << 28) -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, first_word, n_words, n_equal.

    An overlap holds least_words words, or the whole item if that is shorter, of which `similarity` are equal. Of the
    overlaps of a document and an item the longest counts, then the one with more equal words, then the first.
    """
    schema = "doc_id long, item_id long, first_word long, n_words long, n_equal long"
    names = [x.split()[0] for x in schema.split(", ")]
    few = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t"))
    index = small_index(items, similarity, least_words, broadcast_words)
    if index is None:
        found = searched(few, items, similarity, least_words, bitmap_bits)
        return few.select(F.col("i").alias("doc_id"), text_hash(F.col("t")).alias("text")).join(found, "text").select(*names)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *x) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in sent.value.find(t.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)

    return few.mapInArrow(search, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, least_words: int = 12, broadcast_words: int = 2_000_000, bitmap_bits: int = 1 << 28) -> DataFrame:
    """Documents that overlap no item, with all their columns."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t"))
    index = small_index(items, similarity, least_words, broadcast_words)
    if index is None:
        found = searched(docs.select(F.col(text_col).alias("t")), items, similarity, least_words, bitmap_bits).select("text").distinct()
        plain = docs.toDF(*(f"__{i}" for i in range(len(docs.columns))))
        keyed = plain.withColumn("text", text_hash(F.col(f"__{docs.columns.index(text_col)}")))
        return keyed.join(found, "text", "left_anti").drop("text").toDF(*docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not sent.value.find(t.as_py() or "") for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
