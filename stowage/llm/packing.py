"""Packing: shortest-pack-first over the length histogram.

Documents are tokenised, cut into pieces of at most `max_tokens` ids, and the histogram of piece lengths (at
most `max_tokens` numbers, whatever the corpus) is packed on the driver: lengths are placed longest first, each
into the shortest packs that are open. Packs with equal content are kept as one range of sequence ids, so that
the plan's size depends on the number of different lengths only. Pieces then take their places by their rank
within their length. Ids stay out of the ranking: they are shuffled once, to be joined with their places by a number
that each piece got when it was written.

Null texts are empty and become one end token; repeated rows are packed once each; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import cache
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.util import ranked, slices
from stowage.session import materialise

#: Words that a worker keeps with their ids, in each of two generations; longer ones than CACHED_BYTES are not kept.
CACHED_WORDS, CACHED_BYTES = 300_000, 64
#: Words that lower-casing, composing and splitting leave as one: they go to the tokenizer's model itself.
SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
DEFAULT_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, int]:
    """Bytes as byte-level models spell them: printable Latin-1 as it is, the others from U+0100 on in their order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


class WordIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A tokenizer that drops white space and never joins across it gives a text the ids of its words one after
    another, so that each distinct word is encoded once. Whether it does is tried out on a probe; another tokenizer
    gets whole texts.
    """

    PROBE = "The, under  Émigré's\n naïve straße... word, 12 <b>x</b>\tü!? don't"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(path), byte_letters()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.by_word = True
        self.by_word = self(self.PROBE.encode()) == self.whole(self.PROBE)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        stem = text.rstrip(".,;:!?")
        if SIMPLE.fullmatch(stem):
            spelt = stem.lower()
            if spelt != text:  # a capital, or stops, which are a piece of their own: known by its parts
                return self.kept(spelt.encode()) + (self.kept(text[len(stem) :].encode()) if len(stem) < len(text) else b"")
            if not spelt.isascii():
                spelt = spelt.encode().decode("latin-1").translate(self.letters)
            return np.array([t.id for t in self.tokenizer.model.tokenize(spelt)], "<u4").tobytes()
        return self.whole(text)

    def kept(self, word: bytes) -> bytes:
        ids = self.young.get(word) or self.old.get(word)
        if ids is None:
            ids = self.word(word)
        if len(word) <= CACHED_BYTES:
            self.young[word] = ids
        return ids

    def __call__(self, text: bytes) -> bytes:
        if not self.by_word:
            return self.whole(text.decode())
        words = text.split()  # bytes.split() splits at 09 to 0D and 20 alone
        different, long = set(words), {}
        if len(self.young) > CACHED_WORDS:
            self.young, self.old = {}, self.young
        for w in different.difference(self.young):
            ids = self.kept(w)
            if len(w) > CACHED_BYTES:
                long[w] = ids
        ids = {w: self.young[w] if w in self.young else long[w] for w in different} if long else self.young
        return b"".join(map(ids.__getitem__, words))


@cache
def encoder(path: str) -> WordIds:
    """One for each worker process, which keeps its words from task to task."""
    return WordIds(path)


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, max_tokens: int, end_id: int, with_ids: bool) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64()] * 5 + [pa.binary()] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, width = encoder(tokenizer), int(end_id).to_bytes(4, "little"), 4 * max_tokens
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or b"") + end
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    rows.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")).mapInArrow(cut, schema)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places for `histogram` (length -> count): (length, first rank, ranks, first sequence, copies, offset), and the number of sequences.

    Ranks r of a place go to sequence `first sequence + (r - first rank) // copies`, at
    `offset + length * ((r - first rank) % copies)`. Lengths come longest first; the shortest open packs, with
    the largest gap, come first. Where no gap is large enough, new packs take as many copies as fit.
    """
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: ranges (first sequence, packs)
    places, sequences, widest = [], 0, 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            while widest and not gaps[widest]:
                widest -= 1
            if widest >= length:
                first, packs = gaps[widest].pop()
                # as many copies at once as leave these packs the shortest
                lower = next((g for g in range(widest, length - 1, -1) if gaps[g]), length - 1)
                each, gap = max(1, min(widest // length, left // packs, (widest - lower) // length)), widest
                took = min(left // each, packs) if left >= packs else left
                if took < packs:
                    gaps[gap].append((first + took, packs - took))
            else:
                each, gap, first = min(capacity // length, left), capacity, sequences
                took = left // each
                sequences += took
            places.append((length, rank, took * each, first, each, capacity - gap))
            gaps[gap - each * length].append((first, took))
            widest = max(widest, gap - each * length)
            left, rank = left - took * each, rank + took * each
    return places, sequences


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, max_tokens: int = 2048, end_id: int = 1, with_ids: bool = False, rank_buckets: int = 64) -> DataFrame:
    """Pack all documents into sequences of at most `max_tokens` ids.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids
    (little-endian unsigned 32-bit) with `with_ids`. Documents longer than a sequence are cut every `max_tokens`
    ids. Gathered by the driver: the histogram, at most `max_tokens` rows. Sent to executors: the plan, whose
    size depends on the histogram's number of lengths alone.
    """
    cut = pieces(docs, id_col, text_col, tokenizer or tokenizer_path(), max_tokens, end_id, with_ids)
    names = cut.columns
    cut = materialise(cut.withColumn("__piece", F.monotonically_increasing_id()) if with_ids else cut)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places, _ = plan(counts, max_tokens)
    table = np.array(sorted(places), "int64").reshape(-1, 6)
    shift = 1 << 44  # more ranks than a length ever has
    keys = table[:, 0] * shift + table[:, 1]
    sent = docs.sparkSession.sparkContext.broadcast((keys, table))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = sent.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", "__rank"))
            at = table[np.searchsorted(keys, length * shift + rank, "right") - 1] if len(length) else table[:0]
            turn = rank - at[:, 1]
            columns = [c for k, c in zip(batch.schema.names, batch.columns, strict=True) if k != "__rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at[:, 3] + turn // np.maximum(at[:, 4], 1)), pa.array(at[:, 5] + length * (turn % np.maximum(at[:, 4], 1)))], [*(k for k in batch.schema.names if k != "__rank"), "sequence_id", "offset"])

    narrow = cut.drop("ids")
    rows = ranked(narrow.withColumn("__g", F.col("length")), "__g", ["doc_id", "start", "ids_crc32"], rank_buckets).drop("__g", "__group_rows")
    rows = rows.select(*narrow.columns, "__rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema) + ", sequence_id long, offset long"
    placed = rows.mapInArrow(place, schema)
    if not with_ids:
        return placed
    # the places are hashed and the ids pass by unsorted
    placed = placed.select("__piece", "sequence_id", "offset").hint("shuffle_hash")
    return cut.join(placed, "__piece").select(*names, "sequence_id", "offset")


def write_sequences(packed: DataFrame, path: str) -> None:
    """Write packed pieces in order of sequence and offset, near rows in one file."""
    packed.repartitionByRange("sequence_id").sortWithinPartitions("sequence_id", "offset").write.parquet(path)
