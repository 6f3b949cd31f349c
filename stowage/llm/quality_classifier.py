"""Quality classifier: co-training of a text view and a metadata view.

The text view sees the content (hashed words and pairs of words, and figures on words, lines and repeats), the
metadata view source and language and the two together, and nothing of the text. Each is a logistic model whose logits
are calibrated (Platt's scaling) on labelled rows that were not fitted. Over `rounds` rounds each view labels the
unlabelled documents that it is surest of by its calibrated probability (0.9 at least), in the proportions of the
labels, hands them to the other, and is calibrated anew; a view that tells nothing apart there hands on nothing. A
logistic combination of the calibrated logits scores all documents.

Labels come from a bounded sample: `label_rows` labelled documents, chosen by a hash of the id; the driver holds
their features alone. All other documents are the pool that the views exchange, however many there are: their
features are written once, a pass counts logits for the bounds of each round, and each step of Newton's method sums
gradients and Hessians in a pass. Pseudo-labels together weigh no more than the labels that are fitted, so that a
large pool does not drown them. All documents are scored whole, in one pass without a shuffle.

Null texts are empty; null source and lang are values of their own; of several labels of one id the mean counts,
rounded up. Without labels of both kinds every score is 0.5. Repeated rows, and rows without an id, are in the pool
and scored each.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.util import slices
from stowage.session import materialise

WORDS, PAIRS, FIGURES = 256, 128, 8
SOURCES, LANGS, BOTH = 64, 16, 64
TEXT_WIDTH, META_WIDTH = WORDS + PAIRS + FIGURES, SOURCES + LANGS + BOTH
#: Words of a worker that are kept with their hashes.
CACHED_WORDS = 200_000
#: Logits of the pool are ranked in steps of 1 / STEPS; a view is sure of a document from SURE steps on (0.9).
STEPS, SURE = 256, 563
#: From so many partial sums on, executors add them up before the driver does.
PARTIALS = 256


class Words(dict):
    """CRC-32 of words, kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = found = zlib.crc32(word)
        return found


HASHES = Words()


def text_view(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed words and pairs of words, and eight figures on characters, words, lines and repeats."""
    n, words, lines = max(len(text), 1), text.split(), [x for x in text.split(b"\n") if x.strip()]
    h = np.fromiter(map(HASHES.__getitem__, words), "uint64", len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
    k = max(len(words), 1)
    grams = np.concatenate([np.bincount((h % np.uint64(WORDS)).astype("int64"), minlength=WORDS), np.bincount((pairs % np.uint64(PAIRS)).astype("int64"), minlength=PAIRS)])
    counts = np.bincount(np.frombuffer(text, "uint8"), minlength=256)
    letters, upper = counts[97:123].sum() + counts[65:91].sum() + counts[128:].sum(), counts[65:91].sum()
    shape = [np.log1p(len(words)), len(text) / k / 8, len(np.unique(h)) / k, len(np.unique(pairs)) / k, len(set(lines)) / max(len(lines), 1), letters / n, upper / n * 4, counts[48:58].sum() / n * 4]
    return np.concatenate([np.sqrt(grams / k), shape]).astype("float32")


def meta_view(source: str | None, lang: str | None) -> np.ndarray:
    """Hashed source, language, and both together."""
    out = np.zeros(META_WIDTH, "float32")
    out[zlib.crc32(repr(source).encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32(repr(lang).encode()) % LANGS] = 1
    out[SOURCES + LANGS + zlib.crc32(repr((source, lang)).encode()) % BOTH] = 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def derivatives(x: np.ndarray, y: np.ndarray, w: np.ndarray, by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hessian and gradient of the rows, each with its weight `by`, at weights w, the last a bias."""
    x = np.column_stack([x, np.ones(len(x))]).astype("float64")
    by = np.ones(len(x)) if by is None else by
    p = sigmoid(x @ w)
    return (x * (by * (p * (1 - p) + 1e-6))[:, None]).T @ x, x.T @ (by * (y - p))


def newton(w: np.ndarray, hessian: np.ndarray, gradient: np.ndarray, n: float, ridge: float = 1e-3) -> np.ndarray:
    """Step from w with the sums over rows that weigh n together."""
    penalty = np.full(len(w), ridge * n)
    penalty[-1] = 1e-6 * n
    return np.linalg.solve(hessian + np.diag(penalty), gradient - penalty * w)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 12) -> np.ndarray:
    """Weights, the last a bias, by Newton's method; both classes weigh as they are."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        step = newton(w, *derivatives(x, y, w), len(x), ridge)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x.astype("float64") @ w[:-1] + w[-1]


def calibrated(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights whose logits on x are those of a logistic model of y in the logits of w; where these rise against y, none but a bias."""
    a, b = logistic(logit(w, x)[:, None], y, ridge=1e-4)
    out = w * a
    out[-1] += b
    if a <= 0:
        out = np.zeros(len(w))
        out[-1] = np.log(max(y.sum(), 0.5) / max(len(y) - y.sum(), 0.5))
    return out


@dataclass
class Model:
    """Calibrated weights of both views and of the combination of their logits; None in all: nothing was learned."""

    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    joint: np.ndarray | None = None

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.text is None:
            return np.full(len(text), 0.5)
        views = np.column_stack([logit(self.text, text), logit(self.meta, meta)])
        return sigmoid(logit(self.joint, np.clip(views, -15, 15)))


@dataclass
class Bounds:
    """What a view is sure of: bins of its logits above `high` and below `low`, and a share of those two bins."""

    high: int
    high_share: float
    low: int
    low_share: float
    n: float

    @staticmethod
    def of(bins: np.ndarray, counts: np.ndarray, share: float, good: float) -> Bounds:
        """The surest `share` of rows counted by bins, in rising order; `good` of them from the top."""

        def outer(order: np.ndarray, most: int) -> tuple[int, float, float]:
            n = np.cumsum(counts[order])
            if not len(n) or n[-1] <= most:
                return (int(bins[order[-1]]), 1.0, float(n[-1])) if len(n) else (0, 0.0, 0.0)
            k = int(np.searchsorted(n, most))  # rows of one bin are alike: each of the last weighs a part
            return int(bins[order[k]]), float(most - (n[k] - counts[order[k]])) / float(counts[order[k]]), float(most)

        n = max(1, int(share * counts.sum()))
        high, high_share, above = outer(np.flatnonzero(bins >= SURE)[::-1], max(1, int(n * good)))
        low, low_share, below = outer(np.flatnonzero(bins < -SURE), max(1, int(n * (1 - good))))
        return Bounds(high if above else 1 << 40, high_share, low if below else -(1 << 40), low_share, above + below)

    def weights(self, bins: np.ndarray) -> np.ndarray:
        return (bins > self.high) + (bins == self.high) * self.high_share + (bins < self.low) + (bins == self.low) * self.low_share


def binned(logits: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(logits, -128, 128) * STEPS).astype("int64")


class Pool:
    """Documents without labels: a table of x and m, which stays with the executors."""

    def __init__(self, table: DataFrame):
        # passes are short: a few tasks a core take all rows, however many files these are in
        self.parts = min(table.rdd.getNumPartitions(), 4 * table.sparkSession.sparkContext.defaultParallelism)
        self.table = table.select("x", "m").coalesce(max(self.parts, 1))

    def counts(self, weights: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Bins of the logits of each view, in rising order, and their rows."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [Counter() for _ in weights]
            for views in viewed(batches):
                for c, w, v in zip(total, weights, views, strict=True):
                    c.update(dict(zip(*(a.tolist() for a in np.unique(binned(logit(w, v)), return_counts=True)), strict=True)))
            rows = [(k, b, n) for k, c in enumerate(total) for b, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["v", "b", "n"])

        rows = self.table.mapInArrow(count, "v long, b long, n long").groupBy("v", "b").agg(F.sum("n").alias("n")).collect()
        found = np.array(sorted(map(tuple, rows)), "int64").reshape(-1, 3)
        return [(part[:, 1], part[:, 2]) for k in range(len(weights)) for part in [found[found[:, 0] == k]]]

    def sums(self, fixed: list[np.ndarray], bounds: list[Bounds], now: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Hessian and gradient of each view at weights `now`, over what the other is sure of by weights `fixed`."""
        sides = [len(w) for w in now]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [[np.zeros((n, n)), np.zeros(n)] for n in sides]
            for views in viewed(batches):
                for k in (0, 1):
                    bins = binned(logit(fixed[1 - k], views[1 - k]))
                    by = bounds[1 - k].weights(bins)
                    some = by > 0
                    if some.any():
                        hessian, gradient = derivatives(views[k][some], (bins[some] > 0) * 1.0, now[k], by[some])
                        total[k][0] += hessian
                        total[k][1] += gradient
            yield packed(total)

        def packed(total: list[list[np.ndarray]]) -> pa.RecordBatch:
            # a Hessian is the same on both sides of its diagonal
            flat = np.concatenate([a for h, g in total for a in (h[np.triu_indices(len(g))], g)])
            return pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], ["s"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [np.frombuffer(s, "float64") for b in batches for s in b.column(0).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(rows, axis=0).tobytes()], pa.binary())], ["s"])

        parts = self.table.mapInArrow(add, "s binary")
        if self.parts > PARTIALS:
            parts = parts.repartition(PARTIALS // 8).mapInArrow(merge, "s binary")
        flat = np.zeros(sum(n * (n + 1) // 2 + n for n in sides))
        for r in parts.collect():
            flat += np.frombuffer(bytes(r["s"]), "float64")
        out, at = [], 0
        for n in sides:
            hessian, m = np.zeros((n, n)), n * (n + 1) // 2
            hessian[np.triu_indices(n)] = flat[at : at + m]
            out.append((hessian + np.triu(hessian, 1).T, flat[at + m : at + m + n]))
            at += m + n
        return out


def viewed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Both views of batches of x and m."""
    for batch in batches:
        yield tuple(np.frombuffer(b"".join(c.to_pylist()), "float32").reshape(-1, n) for c, n in zip(batch.columns, (TEXT_WIDTH, META_WIDTH), strict=True))


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, fold: np.ndarray, pool: Pool, rounds: int = 3, share: float = 0.1, steps: int = 12) -> Model:
    """fold: True for labelled rows that calibrate. Each round a view passes on `share` of the pool more."""
    fit, views = ~fold, (text, meta)
    if len(set(y[fit])) < 2 or len(set(y[fold])) < 2:
        return Model()
    weights, n = [logistic(v[fit], y[fit]) for v in views], int(fit.sum())
    known = [calibrated(w, v[fold], y[fold]) for w, v in zip(weights, views, strict=True)]
    for turn in range(rounds):
        counts = pool.counts(known)
        if not len(counts[0][0]):
            break
        tells = [w[:-1].any() for w in known]
        bounds = [Bounds.of(*(c if t else (x[:0] for x in c)), share * (turn + 1), y[fit].mean()) for c, t in zip(counts, tells, strict=True)]
        if not any(b.n for b in bounds):
            break
        each = [min(1.0, n / max(b.n, 1.0)) for b in bounds[::-1]]  # weight of a pseudo-label that a view gets
        weights = [np.zeros(len(w)) for w in known]  # from sure weights steps could go astray
        for _ in range(steps):
            moved = 0.0
            for k, (hessian, gradient) in enumerate(pool.sums(known, bounds, weights)):
                own = derivatives(views[k][fit], y[fit], weights[k])
                step = newton(weights[k], own[0] + each[k] * hessian, own[1] + each[k] * gradient, n + each[k] * bounds[1 - k].n)
                weights[k] += step
                moved = max(moved, np.abs(step).max())
            if moved < 1e-4:  # what is left is about its square
                break
        known = [calibrated(w, v[fold], y[fold]) for w, v in zip(weights, views, strict=True)]
    held = np.column_stack([logit(w, v[fold]) for w, v in zip(known, views, strict=True)])
    return Model(*known, logistic(np.clip(held, -15, 15), y[fold], ridge=1e-4))


def features(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Columns `extra`, x and m (float32 bytes of both views) of rows (extra, text as binary, source, lang)."""
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name in extra) + "x binary, m binary"

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            texts = [t.as_py() or b"" for t in get["text"]]
            x = pa.array([text_view(t).tobytes() for t in texts], pa.binary())
            m = pa.array([meta_view(*r).tobytes() for r in zip(get["source"].to_pylist(), get["lang"].to_pylist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(get[k] for k in extra), x, m], [*extra, "x", "m"])

    return rows.mapInArrow(view, schema)


def gathered(rows: list, key: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(r[key]) for r in rows), "float32").reshape(-1, width)


def labelled_features(docs: DataFrame, labels: DataFrame, label_col: str = "quality", label_rows: int = 4000) -> DataFrame:
    """doc_id, y (null: not in the sample of labels), x and m of all documents, written."""
    order = F.xxhash64(F.lit(6), F.col("doc_id"))
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg(label_col)).cast("int").alias("y"))
    known = known.orderBy(order, "doc_id").limit(label_rows)
    few = docs.select("doc_id", F.col("text").cast("binary").alias("text"), "source", "lang")
    # the sample of labels is bounded by a parameter, and so may be broadcast
    few = few.join(F.broadcast(known), "doc_id", "left").select("doc_id", "y", "text", "source", "lang")
    return materialise(features(few, ["doc_id", "y"]))


def train(table: DataFrame, rounds: int = 3) -> Model:
    """Model from labelled_features()."""
    one = table.where(F.col("y").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("y", "x", "m")).alias("s"))  # of repeated ids one row
    labelled = sorted(one.select("doc_id", "s.*").toLocalIterator(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in labelled], float)
    fold = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 4 == 0 for r in labelled], bool)
    return cotrain(gathered(labelled, "x", TEXT_WIDTH), gathered(labelled, "m", META_WIDTH), y, fold, Pool(table.where(F.col("y").isNull())), rounds=rounds)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", label_rows: int = 4000, rounds: int = 3) -> Model:
    """Model from labels (doc_id, label_col: 0 or 1) and documents (doc_id, text, lang, source)."""
    return train(labelled_features(docs, labels, label_col, label_rows), rounds)


def fit_and_score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", label_rows: int = 4000, rounds: int = 3, threshold: float = 0.5) -> DataFrame:
    """score() of the documents that fit() learns from, with the features that are written already."""
    table = labelled_features(docs, labels, label_col, label_rows)
    sent = docs.sparkSession.sparkContext.broadcast(train(table, rounds))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "float32").reshape(-1, n) for i, n in ((1, TEXT_WIDTH), (2, META_WIDTH)))
            p = sent.value.score(x, m)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= threshold)], ["doc_id", "score", "kept"])

    return table.select(F.col("doc_id").cast("long").alias("doc_id"), "x", "m").mapInArrow(scored, "doc_id long, score double, kept boolean")


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (probability of quality 1) and kept (score >= threshold) of all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            ids, texts, sources, langs = batch.columns
            texts = [t.as_py() or b"" for t in texts]
            x = np.array([text_view(t) for t in texts], "float32").reshape(-1, TEXT_WIDTH)
            m = np.array([meta_view(*r) for r in zip(sources.to_pylist(), langs.to_pylist(), strict=True)], "float32").reshape(-1, META_WIDTH)
            p = sent.value.score(x, m)
            yield pa.RecordBatch.from_arrays([ids, pa.array(p), pa.array(p >= threshold)], ["doc_id", "score", "kept"])

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "source", "lang")
    return few.mapInArrow(scored, "doc_id long, score double, kept boolean")
