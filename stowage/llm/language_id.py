"""Language ID: unigram pieces with all segmentations summed.

The pieces are those of a fixed public vocabulary; each language has a probability for each piece, estimated by
expectation maximisation over all segmentations of its words. A word's probability in a language is the sum over
all ways to cut it into pieces (the forward algorithm), a text's the product over its words: pieces never join
words, so that each distinct word is summed once and its figures are kept. New words of a batch are summed
together, all words of one length and all languages in one step of the algorithm. Longer words are summed whole too:
sums are rescaled as they shrink, and only as many are kept as a piece is long, so that a text without a space in it
takes memory for its characters alone.

Learned from a bounded sample of labelled rows: about `fit_rows` documents a language, chosen by a hash of the
id. All texts are scored whole. Null texts and texts without a letter get `und` and score 0; with nothing to
learn from every text gets `und`. Languages with an equal score go by name. Repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.util import slices

#: Probability of one character that is no piece, in any language.
UNKNOWN = 1e-7
#: Added to each piece's expected count.
SMOOTHING = 0.05
#: Longest words whose products of probabilities surely stay above the smallest float.
PLAIN = 32
#: Sums under 1 / SCALE are multiplied by it.
SCALE = 2.0**256
#: Positions of longer words whose pieces are looked up at once, and characters of such words that are worked on together.
STRETCH, TOGETHER = 4096, 1 << 18
CACHED_WORDS, CACHED_CHARS = 150_000, 48
#: Rows of a batch that are worked on together.
ROWS = 1024
BASE = np.uint64(0x9E3779B97F4A7C15)
WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter; numbers such as fractions and superscripts are none."""
    first = WORDLIKE.search(text)
    return first is not None and (first.group().isalpha() or any(map(str.isalpha, text)))


def public_pieces(path: str | None = None) -> list[str]:
    """Pieces of a sentencepiece vocabulary, lower case, without marks of word starts; in order and once each."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (p.id_to_piece(i).replace("▁", "").lower() for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i)))
    return sorted({x for x in plain if x})


class Lattice:
    """Ways to cut a word: (start, end, piece) triples in order of end."""

    def __init__(self, pieces: list[str]):
        self.ids = {x: i for i, x in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)

    def __call__(self, word: str) -> list[tuple[int, int, int]]:
        get, out = self.ids.get, []
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                if (k := get(word[start:end])) is not None:
                    out.append((start, end, k))
            if word[end - 1] not in self.ids:
                out.append((end - 1, end, -1))
        return out


def forward(arcs: list[tuple[int, int, int]], n: int, p: list[float]) -> tuple[list[float], list[int]]:
    """a and s: a[i] / SCALE ** s[i] is the sum over all segmentations of the first i characters; p's last entry is that of an unknown one."""
    a, s = [1.0] + [0.0] * n, [0] * (n + 1)
    if n <= PLAIN:
        for start, end, k in arcs:
            a[end] += a[start] * p[k]
        return a, s
    at = 0
    for start, end, k in arcs:
        if end != at:
            if a[at] < 1 / SCALE:
                a[at], s[at] = a[at] * SCALE, s[at] + 1
            at, s[end] = end, s[at]
        a[end] += a[start] * p[k] * SCALE ** (s[end] - s[start])
    return a, s


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = 2) -> dict[str, list[float]]:
    """Piece probabilities for each language from its word counts, by expectation maximisation; start: all pieces alike."""
    lattice, out = Lattice(pieces), {}
    for lang in sorted(counts):
        arcs = [(lattice(w), len(w), n) for w, n in sorted(counts[lang].items())]
        p = [1 / (len(pieces) + 1)] * len(pieces) + [UNKNOWN]
        for _ in range(rounds):
            expected = [SMOOTHING] * len(pieces)
            for ways, n, times in arcs:
                a, s = forward(ways, n, p)
                b = [0.0] * n + [times / a[n]]
                for start, end, k in reversed(ways):
                    got = p[k] * b[end]
                    if s[end] != s[start]:
                        got *= SCALE ** (s[end] - s[start])
                    b[start] += got
                    if k >= 0:
                        expected[k] += a[start] * got
            total = sum(expected)
            p = [x / total for x in expected] + [UNKNOWN]
        out[lang] = p
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n over the rows (lang, text as binary): counted in each partition, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[lang].update((text.as_py() or b"").decode(errors="replace").lower().encode(errors="replace").split())
            rows = [(lang, w.decode(), n) for lang, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    return texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_rows: int = 300, pieces: list[str] | None = None) -> dict[str, list[float]]:
    """Model from the rows of labelled with a language; the sample holds about fit_rows rows a language.

    The driver gathers one row for each language and the distinct words of the sample.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = {r[0]: min(1.0, fit_rows / r[1]) for r in rows.groupBy(lang_col).agg(F.count(F.lit(1))).collect()}
    if not share:
        return {}
    position = F.pmod(F.xxhash64(F.lit(9), F.col(id_col)), F.lit(1 << 20)) / float(1 << 20)
    chosen = F.coalesce(*(F.when(F.col(lang_col) == k, F.lit(v)) for k, v in sorted(share.items())))
    sample = rows.where(position < chosen).select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("binary").alias("t"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in word_counts(sample).toLocalIterator():
        counts[r["lang"]][r["word"]] = r["n"]
    return fit(counts, pieces or public_pieces())


class Scorer:
    """Log probabilities of many words in all languages, by the forward algorithm over columns of characters."""

    def __init__(self, pieces: list[str], tables: list[list[float]]):
        self.longest = max(map(len, pieces), default=1)
        # rows of p: pieces, an unknown character, no piece
        self.p = np.array([[*t, 0.0] for t in tables]).T.copy()
        self.unknown, self.none = len(pieces), len(pieces) + 1
        codes = np.array([self.code(np.frombuffer(x.encode("utf-32-le"), "uint32").astype("uint64")) for x in pieces], "uint64")
        self.bits = max(16, (64 * len(codes)).bit_length())
        self.slots = np.full(1 << self.bits, self.none, "int32")
        self.more: dict[int, int] = {}  # codes whose slot is taken
        for k, c in enumerate(codes.tolist()):
            slot = c >> (64 - self.bits)
            if self.slots[slot] == self.none:
                self.slots[slot] = k
            else:
                self.more[c] = k
        self.crowded = np.zeros(1 << self.bits, bool)
        self.crowded[[c >> (64 - self.bits) for c in self.more]] = True
        self.codes = np.concatenate([codes, np.zeros(2, "uint64")])

    @staticmethod
    def code(chars: np.ndarray) -> int:
        h = 0
        for c in chars.tolist():
            h = (h + c + 1) * int(BASE) % (1 << 64)
        return h

    def ids(self, h: np.ndarray) -> np.ndarray:
        slot = h >> np.uint64(64 - self.bits)
        k = self.slots[slot]
        out = np.where(self.codes[k] == h, k, self.none)
        for i in np.argwhere(self.crowded[slot] & (out == self.none)):
            out[tuple(i)] = self.more.get(int(h[tuple(i)]), self.none)
        return out

    def __call__(self, words: list[str]) -> np.ndarray:
        """A row for each word."""
        out = np.zeros((len(words), self.p.shape[1]))
        by: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            by[len(w)].append(k)
        for n, members in by.items():
            if n > PLAIN:
                continue
            chars = np.frombuffer("".join(words[k] for k in members).encode("utf-32-le", "surrogatepass"), "uint32").reshape(-1, n).astype("uint64")
            h, found = np.zeros_like(chars), []
            for m in range(min(self.longest, n)):  # h: codes of the m + 1 characters from each place
                h = (h[:, : n - m] + chars[:, m:] + np.uint64(1)) * BASE
                k = self.ids(h)
                found.append(np.where(k == self.none, self.unknown, k) if m == 0 else k)
            a = np.zeros((n + 1, len(members), self.p.shape[1]))
            a[0] = 1
            for end in range(1, n + 1):
                for m in range(min(self.longest, end)):
                    k = found[m][:, end - m - 1]
                    if m == 0:
                        a[end] += a[end - 1] * self.p[k]
                    elif len(some := np.flatnonzero(k != self.none)):
                        a[end, some] += a[end - m - 1, some] * self.p[k[some]]
            out[members] = np.log(a[n])
        long = sorted((n, k) for n, ks in by.items() if n > PLAIN for k in ks)
        while long:  # words of like lengths together, as many as stand in memory
            members = [k for i, (n, k) in enumerate(long) if not i or (4 * n <= 5 * long[0][0] and (i + 1) * n <= TOGETHER)]
            out[members] = self.whole([words[k] for k in members])
            long = long[len(members) :]
        return out

    def whole(self, words: list[str]) -> np.ndarray:
        """Of words longer than PLAIN in rising order of length. Shorter ones are filled up, which comes after their own sums."""
        sizes, langs, kept = [len(w) for w in words], self.p.shape[1], self.longest + 1
        chars = np.zeros((len(words), sizes[-1]), "uint32")
        for row, w in zip(chars, words, strict=True):
            row[: len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "uint32")
        a, scaled, out = np.zeros((kept, len(words), langs)), np.zeros((len(words), langs)), np.zeros((len(words), langs))
        a[0] = 1  # the sum at position i is a[i % kept] / SCALE ** scaled
        for begin in range(0, sizes[-1], STRETCH):
            low, stop = max(0, begin + 1 - self.longest), min(sizes[-1], begin + STRETCH)
            part = chars[:, low:stop].astype("uint64")
            h, found, there = np.zeros_like(part), [], []
            for m in range(min(self.longest, stop - low)):
                h = (h[:, : part.shape[1] - m] + part[:, m:] + np.uint64(1)) * BASE
                k = self.ids(h)
                found.append(np.where(k == self.none, self.unknown, k) if m == 0 else k)
                there.append((k != self.none).any(0))
            for end in range(begin + 1, stop + 1):
                total = a[(end - 1) % kept] * self.p[found[0][:, end - 1 - low]]
                for m in range(1, min(self.longest, end - low)):
                    if there[m][end - m - 1 - low]:
                        total += a[(end - m - 1) % kept] * self.p[found[m][:, end - m - 1 - low]]  # p of no piece is 0
                a[end % kept] = total
                if end % 8 == 0 and total.min() < 1 / SCALE:
                    small = total < 1 / SCALE
                    a *= np.where(small, SCALE, 1.0)
                    scaled += small
                if end >= sizes[0]:
                    done = slice(*np.searchsorted(sizes, [end, end + 1]))
                    out[done] = np.log(a[end % kept, done]) - scaled[done] * np.log(SCALE)
        return out


def predict(docs: DataFrame, model: dict[str, list[float]], text_col: str = "text", pieces: list[str] | None = None) -> DataFrame:
    """docs' columns, lang_pred and score: the best language's share of the sum over languages."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    keep = [c for c in names if c != text_col]
    langs = sorted(model)
    sent = docs.sparkSession.sparkContext.broadcast((pieces or public_pieces(), [model[k] for k in langs]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, cache, figures = Scorer(*sent.value) if langs else None, {}, np.zeros((0, len(langs)))
        for batch in slices(batches, ROWS):
            texts = ((t.as_py() or b"").decode(errors="replace").lower() for t in batch.column(batch.schema.get_field_index("__t")))
            texts = [t.encode(errors="replace").split() if langs and has_letter(t) else None for t in texts]
            if len(cache) > CACHED_WORDS:
                cache, figures = {}, figures[:0]
            new = {w for t in texts if t for w in t if w not in cache}
            if new:
                short = sorted(w for w in new if len(w) <= CACHED_CHARS)
                long = sorted(w for w in new if len(w) > CACHED_CHARS)
                cache.update(zip(short, range(len(cache), len(cache) + len(short)), strict=True))
                figures = np.concatenate([figures, scorer([w.decode() for w in short])])
                extra = dict(zip(long, scorer([w.decode() for w in long]), strict=True)) if long else {}
            best, shares = [], []
            for t in texts:
                if t is None:
                    best.append("und")
                    shares.append(0.0)
                    continue
                total = figures[[cache[w] for w in t if w in cache]].sum(0)
                for w in t:
                    if len(w) > CACHED_CHARS:
                        total = total + extra[w]
                odds = np.exp(total - total.max())
                best.append(langs[int(odds.argmax())])
                shares.append(float(odds.max() / odds.sum()))
            columns = [c for k, c in zip(batch.schema.names, batch.columns, strict=True) if k != "__t"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.string()), pa.array(shares, pa.float64())], [*(k for k in batch.schema.names if k != "__t"), "lang_pred", "score"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in keep) + "lang_pred string, score double"
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).cast("binary").alias("__t")).mapInArrow(score, schema)


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the rows that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, fit_rows: int = 300) -> DataFrame:
    """Learn from the rows of documents that are not held out, and predict all of them: doc_id, held_out, lang_pred, score.

    Null ids have no remainder and are not held out.
    """
    few = docs.select("doc_id", "text", "lang")
    model = learn(few.where(~held_out()), fit_rows=fit_rows)
    return predict(few.select("doc_id", held_out().alias("held_out"), "text"), model)


def keep_identified(docs: DataFrame, least: float = 0.5, fit_rows: int = 300) -> DataFrame:
    """Documents without those that are rejected: no letter at all, or no language with a share over `least`.

    A null lang is filled with the prediction; all columns stay.
    """
    model = learn(docs.where(~held_out()), fit_rows=fit_rows)
    # numbers for names, as a column of the documents may be called like one of the prediction
    plain = docs.toDF(*(f"__{i}" for i in range(len(docs.columns)))).withColumn("__copy", F.col(f"__{docs.columns.index('text')}"))
    found = predict(plain, model, text_col="__copy")
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") > least))
    lang = f"__{docs.columns.index('lang')}"
    return found.withColumn(lang, F.coalesce(lang, "lang_pred")).drop("lang_pred", "score").toDF(*docs.columns)
