"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each document has a vector of transformed statistics. For each language and source the mean and covariance of the
`inside` share of documents with the smallest covariance determinant are sought: from three deterministic starts
(mean with covariance, median with median absolute deviation, median with the covariance of spatial signs)
concentration steps take the nearest documents and estimate anew, as long as the determinant falls (`most_steps` at
most, a bound for the sake of time); the start that ends with the smallest determinant counts.
Documents beyond a Mahalanobis distance are rejected.

Everything is DataFrame expressions. Statistics are made in one pass over the texts and kept without them. Medians
and nearest shares are read from histograms of 1 / STEPS wide bins, those of distances by their logarithm, so that
they are the same however rows are dealt; bins are counted and estimates summed before they are shuffled, and the
tables of groups are broadcast up to `broadcast_groups` rows, so that a hot source is no hot task. Groups under `least_rows`
documents are pooled over the sources of their language; if that is too few, nothing more than the base rules is asked.

`least_spread` are the smallest standard deviations that estimates may have, by statistic: where a statistic hardly
varies (most texts repeat no line), no document is rejected for a trifle.

Null texts have no words and fail the base rules; null languages and sources are groups like others; repeated
rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.util import group_key, words
from stowage.session import materialise

DIM = 5
PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]
#: Least standard deviations: logarithm of words, letters a word, and roots of the shares of symbols, repeated lines and repeated words.
LEAST_SPREAD = (0.35, 0.3, 0.06, 0.08, 0.12)
#: Bins of a unit of a statistic, and of the logarithm of 1 + a distance.
STEPS = 256
SYMBOLS = "#*$%&|<>"


def statistics(docs: DataFrame, text_col: str = "text", code_words: int = 1 << 24) -> DataFrame:
    """docs without its text and with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long).

    code_words: words up to which a place has room beside a hash.
    """
    names = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(*(F.col(f"`{c}`") for c in names), text.alias("__t"), words(F.col(text_col)).alias("__w"))
    n = F.size("__w")
    w = F.col("__w")
    grams = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))
    bare = F.translate("__t", " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(*(F.col(f"`{c}`") for c in names), n.cast("long").alias("n_words"), F.length(bare).cast("long").alias("word_chars"), (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("__l"), F.when(n > 2, grams).alias("__g"))
    df = df.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long")).drop("__l")
    # most texts repeat no three words; only the others' windows are sorted, by 40 bits of a hash and the place
    repeats = F.size(F.array_distinct("__g")) < F.size("__g")
    code = F.transform("__g", lambda g, i: F.xxhash64(g).bitwiseAND(F.lit(~0xFFFFFF)).bitwiseOR(i.cast("long")))
    df = df.withColumn("__c", F.when(repeats & (F.col("n_words") <= code_words), F.sort_array(code)))
    at = lambda x: x.bitwiseAND(F.lit(0xFFFFFF)).cast("int")
    near = lambda x, y: F.coalesce(F.shiftrightunsigned(x, 24) == F.shiftrightunsigned(y, 24), F.lit(False))
    again = F.filter("__c", lambda x, k: near(x, F.get("__c", k + 1)) | near(x, F.get("__c", k - 1)))
    unlike = F.filter("__c", lambda x, k: near(x, F.get("__c", k + 1)) & (F.get("__g", at(x)) != F.get("__g", at(F.get("__c", k + 1)))))
    df = df.withColumn("__p", F.sort_array(F.transform(again, at))).withColumn("__u", F.size(unlike) > 0)
    # where bits of different windows are equal, or places need more of them, the windows themselves are sorted
    whole = F.when(F.coalesce("__u", F.lit(True)) & repeats, F.sort_array(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    df = df.withColumn("__s", whole)
    same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
    sure = F.transform(F.filter("__s", lambda x, k: same(x, F.get("__s", k + 1)) | same(x, F.get("__s", k - 1))), lambda x: x["i"])
    df = df.withColumn("__p", F.coalesce(F.sort_array(sure), "__p")).drop("__g", "__c", "__u", "__s")
    covered = F.transform("__p", lambda p, k: F.least(F.lit(3), p - F.coalesce(F.get("__p", k - 1), F.lit(-3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("__p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [F.log1p("n_words"), chars / n, F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]


def chi2_cdf(x: float, k: int) -> float:
    """Lower regularised gamma function by its series."""
    term = total = 1 / math.gamma(k / 2 + 1)
    for i in range(1, 500):
        term *= x / 2 / (k / 2 + i)
        total += term
    return total * (x / 2) ** (k / 2) * math.exp(-x / 2)


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < p else (low, middle)
    return low


def inverted(model: DataFrame, keys: list[str], spread: tuple[float, ...]) -> DataFrame:
    """From keys, m{i} and c{i}_{j} to keys, m{i}, p{i}_{j} (inverse of the floored covariance) and ldet, by Cholesky's factors."""
    df = model
    for i, j in PAIRS:
        c = F.col(f"c{i}_{j}")
        if i == j:
            c = F.greatest(c, F.lit(spread[i] ** 2))
        for k in range(j):
            c = c - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        value = F.sqrt(F.greatest(c, F.lit(spread[i] ** 2 / 4))) if i == j else c / F.col(f"l{j}_{j}")
        df = df.withColumn(f"l{i}_{j}", value)
    for i, j in PAIRS:  # r: inverse of l
        r = F.lit(1.0) if i == j else -sum((F.col(f"l{i}_{k}") * F.col(f"r{k}_{j}") for k in range(j, i)), F.lit(0.0))
        df = df.withColumn(f"r{i}_{j}", r / F.col(f"l{i}_{i}"))
    out = [sum((F.col(f"r{k}_{i}") * F.col(f"r{k}_{j}") for k in range(i, DIM)), F.lit(0.0)).alias(f"p{i}_{j}") for i, j in PAIRS]
    ldet = sum((F.log(f"l{i}_{i}") for i in range(DIM)), F.lit(0.0))
    return df.select(*keys, *(f"m{i}" for i in range(DIM)), *out, ldet.alias("ldet"))


def distance() -> Column:
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(DIM)]
    return sum(((1 if i == j else 2) * F.col(f"p{i}_{j}") * d[i] * d[j] for i, j in PAIRS), F.lit(0.0))


def groups(stats: DataFrame, least_rows: int) -> DataFrame:
    """__k (language and source) to __group: itself, its language's pool, or null; one row for each __k."""
    counts = stats.groupBy("__k", "__lang").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < least_rows
    pool = F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy("__lang"))
    return counts.select("__k", F.when(~small, F.concat(F.lit("s"), "__k")).when(pool >= least_rows, F.concat(F.lit("l"), "__lang")).alias("__group"))


XS = [f"x{i}" for i in range(DIM)]


def hinted(table: DataFrame, small: bool) -> DataFrame:
    """A table of groups, to be broadcast if it is known to be small."""
    return F.broadcast(table) if small else table


def free_driver(df: DataFrame) -> None:
    """Collect the driver's garbage: broadcast tables of ended steps are only removed when their handles are."""
    df.sparkSession._jvm.java.lang.System.gc()


def moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means and covariances of rows (keys, x0 to x4)."""
    return rows.groupBy(*keys).agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(XS)), *(F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in PAIRS))


def reached(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """keys and bin: of counts (keys, bin, n) the smallest bin up to which `share` of the rows lie."""
    w = Window.partitionBy(*keys)
    running = counts.select(*keys, "bin", F.sum("n").over(w.orderBy("bin")).alias("before"), F.sum("n").over(w).alias("all"))
    return running.where(F.col("before") >= F.ceil(F.col("all") * F.lit(share))).groupBy(*keys).agg(F.min("bin").alias("bin"))


def medians(rows: DataFrame, columns: list, names: list[str]) -> DataFrame:
    """__group and a median of each of the columns, to the middle of a bin."""
    bins = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.floor(c * STEPS).cast("long").alias("bin")) for k, c in enumerate(columns))))
    counts = rows.select("__group", bins.alias("b")).groupBy("__group", "b.k", "b.bin").agg(F.count(F.lit(1)).alias("n"))
    found = reached(counts, ["__group", "k"], 0.5)
    return found.groupBy("__group").agg(*(F.max(F.when(F.col("k") == k, (F.col("bin") + 0.5) / STEPS)).alias(name) for k, name in enumerate(names)))


def distance_bin() -> Column:
    return F.floor(F.log1p(F.greatest(distance(), F.lit(0.0))) * STEPS).cast("long")


def estimates(vectors: DataFrame, inside: float, most_steps: int, spread: tuple[float, ...] = LEAST_SPREAD, broadcast_groups: int = 100_000) -> DataFrame:
    """__group, m, p and ldet from vectors (__group, x0 to x4), by deterministic starts and concentration steps."""
    keys, ms = ["__group", "__start"], [f"m{i}" for i in range(DIM)]
    cs = [f"c{i}_{j}" for i, j in PAIRS]
    start = lambda df, k: df.select("__group", F.lit(k).alias("__start"), *ms, *cs)
    classic = materialise(moments(vectors, ["__group"]))
    middle = materialise(medians(vectors, [F.col(x) for x in XS], ms))
    small = 3 * middle.count() <= broadcast_groups  # all tables below have a row for each group and start at most
    off = vectors.join(hinted(middle, small), "__group")
    mads = materialise(medians(off, [F.abs(F.col(x) - F.col(m)) for x, m in zip(XS, ms, strict=True)], [f"a{i}" for i in range(DIM)]))
    # 1.4826: a normal variable's standard deviation over its median absolute deviation
    scale = [F.greatest(F.col(f"a{i}") * 1.4826, F.lit(spread[i])) for i in range(DIM)]
    spreads = materialise(middle.join(mads, "__group").select("__group", *ms, *(v.alias(f"s{i}") for i, v in enumerate(scale))))
    robust = spreads.select("__group", *ms, *((F.pow(f"s{i}", 2) if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in PAIRS))
    z = vectors.join(hinted(spreads, small), "__group")
    z = z.select("__group", *((F.col(x) - F.col(f"m{i}")).alias(f"x{i}") for i, x in enumerate(XS)), *(f"s{i}" for i in range(DIM)))
    norm = sum((F.pow(F.col(x) / F.col(f"s{i}"), 2) for i, x in enumerate(XS)), F.lit(0.0))
    # as wide as a normal sample's: a sign has a DIM-th of its square in each direction
    signs = z.withColumn("w", DIM / F.greatest(norm, F.lit(1e-12))).groupBy("__group").agg(*(F.avg(F.col(f"x{i}") * F.col(f"x{j}") * F.col("w")).alias(f"c{i}_{j}") for i, j in PAIRS))
    signs = spreads.select("__group", *ms).join(signs, "__group")
    starts = start(classic, 0).unionByName(start(robust, 1)).unionByName(start(signs, 2))
    model = materialise(inverted(starts, keys, spread))
    # the covariance of the nearest share of a normal sample, made that of the whole
    wide = inside / chi2_cdf(chi2_quantile(inside, DIM), DIM + 2)
    names = [c for c in model.columns if c not in keys]
    ended, active = [], model
    for step in range(most_steps):
        near = vectors.join(hinted(active, small), "__group").select(*keys, *XS, distance_bin().alias("bin"))
        bound = materialise(reached(near.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")), keys, inside).withColumnRenamed("bin", "__most"))
        bounded = vectors.join(hinted(materialise(active.join(bound, keys)), small), "__group")
        chosen = moments(bounded.where(distance_bin() <= F.col("__most")).select(*keys, *XS), keys)
        chosen = chosen.select(*keys, *ms, *((F.col(c) * wide).alias(c) for c in cs))
        stepped = inverted(chosen, keys, spread)
        if step:  # a start's own covariance is that of no share
            stepped = stepped.join(active.select(*keys, F.col("ldet").alias("__old")), keys).where(F.col("ldet") < F.col("__old") - 1e-9).drop("__old")
        stepped = materialise(stepped)
        if step:
            ended.append(active.join(stepped.select(*keys), keys, "left_anti"))
        active = stepped
        if active.isEmpty():
            break
        free_driver(vectors)
    for rest in ended:
        active = active.unionByName(rest)
    model = active
    best = model.groupBy("__group").agg(F.min(F.struct("ldet", "__start", *(c for c in names if c != "ldet"))).alias("s"))
    return materialise(best.select("__group", *(f"s.{c}" for c in names)))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", inside: float = 0.75, most_steps: int = 30, beyond: float = 1e-5, least_rows: int = 50, least_spread: tuple[float, ...] = LEAST_SPREAD, broadcast_groups: int = 100_000) -> DataFrame:
    """A row for each document: id, the statistics, base_failed, distance (null: not estimated) and kept.

    `beyond` is the share of a normal sample that the distance would reject.
    """
    few = docs.select(F.col(id_col), F.col(text_col), group_key(F.col(lang_col)).alias("__lang"), group_key(F.col(source_col)).alias("__source"))
    stats = statistics(few, text_col).withColumn("base_failed", base_failed())
    stats = stats.withColumn("__k", F.concat_ws("\x00", "__lang", "__source")).drop("__source")
    stats = materialise(stats.select("*", *(x.alias(f"x{i}") for i, x in enumerate(vector()))))
    passed = stats.where(~F.col("base_failed"))
    grouped = materialise(groups(passed, least_rows))
    small = grouped.count() <= broadcast_groups
    vectors = passed.join(hinted(grouped, small), "__k").where(F.col("__group").isNotNull()).select("__group", *XS)
    model = materialise(grouped.join(estimates(vectors, inside, most_steps, least_spread, broadcast_groups), "__group").drop("__group", "ldet"))
    out = stats.join(hinted(model, small), "__k", "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(1 - beyond, DIM), F.lit(True))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
