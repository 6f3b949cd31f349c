"""Secret scans: spans of credential patterns, and corpus-wide ownership frequency of what may be a secret.

Base spans come from three patterns. Candidates are the values of base spans and long tokens of letters and digits;
the hash of each is counted over the corpus by distinct owners and repositories. A candidate that more than
`most_owners` owners hold in more than `most_repositories` repositories is a widely copied example. All others
belong to few and are live-looking; such tokens become spans of kind `live`.

A secret does not stop being one when its document is copied into another source: rows of equal text have one owner
and repository between them, the first by name.

Everything is DataFrame expressions. Texts are read once and never shuffled for the scan; only hashes and places
are. Distinct (text, hash) and (hash, owner, repository) come before the counts, so that a token copied into a third
of all documents is no hot group; verdicts of hashes that very many texts hold are broadcast to their places.

Null texts are empty; null repositories and owners are values like others; repeated rows get equal spans. Places
are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.util import group_key, with_prefix_sums
from stowage.session import materialise

#: kind, Java regex, group whose length counts, least length. In the order in which spans of one start come.
#: Runs of one class of characters that are too short can be left to the regex; a failing assignment takes its text.
KINDS = (
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Owners and repositories, over distinct texts, that a candidate may have and still be a secret.
SECRET_OWNERS, SECRET_REPOSITORIES = 7, 9
#: Texts from which on a hash is hot, and how many such hashes are broadcast.
HOT_TEXTS, HOT_HASHES = 10_000, 100_000
SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
PLACE = "array<struct<start:bigint,end:bigint,hash:string,token:boolean>>"
VERDICT = "array<struct<start:bigint,end:bigint,token:boolean,live:boolean,owners:bigint,repositories:bigint>>"


def _spans(df: DataFrame, out: str, pattern: str, group: int, least: int, kind: int) -> DataFrame:
    """Add `out`: spans (start, kind, end, value) of the leftmost non-overlapping matches in __t whose group is long enough.

    A text is what lies between the matches and the matches in turn, so that lengths give the places.
    """
    hit = F.col("__t").rlike(pattern)
    length = lambda x: F.length(x).cast("long")
    df = df.withColumn("__found", F.when(hit, F.regexp_extract_all("__t", F.lit(pattern), 0)))
    counted = F.col("__found") if group == 0 else F.when(hit, F.regexp_extract_all("__t", F.lit(pattern), group))
    df = df.withColumn("__value", counted).withColumn("__gaps", F.when(hit, F.transform(F.split("__t", pattern, -1), length)))
    df = df.withColumn("__both", F.zip_with(F.slice("__gaps", 1, F.size("__found")), F.transform("__found", length), lambda a, b: a + b))
    df = with_prefix_sums(df, "__both", "__before")
    at, after = (lambda i: F.get("__before", i) + F.get("__gaps", i)), (lambda i: F.get("__before", i) + F.get("__both", i))
    span = lambda x, i: F.struct(at(i).alias("start"), F.lit(kind).alias("kind"), after(i).alias("end"), x.alias("value"))
    df = df.withColumn(out, F.filter(F.transform("__value", span), lambda s: F.length(s["value"]) >= least))
    return df.withColumn(out, F.coalesce(out, F.array().cast(SPAN))).drop("__found", "__value", "__gaps", "__both", "__before")


def text_key(text: Column) -> Column:
    return F.concat_ws(":", F.xxhash64(text), F.length(text))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, with base (spans by start and kind), candidates (start, end, hash, token) and __key of the text."""
    names = [c for c in docs.columns if c != text_col]
    df = docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit(""))).drop(text_col)
    for k, (kind, pattern, group, least) in enumerate(KINDS):
        df = _spans(df, f"__{kind}", pattern, group, least, k)
    df = _spans(df, "__token", TOKEN, 0, 20, len(KINDS))
    mixed = F.filter("__token", lambda s: s["value"].rlike("[0-9].*[0-9]") & s["value"].rlike("[A-Za-z].*[A-Za-z]"))
    # a value ends where its match ends
    place = lambda token: lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"), F.lit(token).alias("token"))
    found = F.concat(*(f"__{kind}" for kind, *_ in KINDS))
    df = df.withColumn("__tokens", F.coalesce(F.transform(mixed, place(True)), F.array().cast(PLACE)))
    values = F.filter(F.array_distinct(F.transform(found, place(False))), lambda v: ~F.exists("__tokens", lambda t: (t["start"] == v["start"]) & (t["end"] == v["end"])))
    base = F.sort_array(F.transform(found, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return df.select(*(F.col(f"`{c}`") for c in names), *(F.size(f"__{kind}").cast("long").alias(f"n_{kind}") for kind, *_ in KINDS), base.alias("base"), F.concat("__tokens", values).alias("candidates"), text_key(F.col("__t")).alias("__key"))


def ownership(found: DataFrame, owner: Column, repository: Column, most_owners: int, most_repositories: int) -> DataFrame:
    """hash, owners, repositories, texts and live of each candidate in found (candidates, __key). Rows of one text have one repository."""
    mark = "\x00"  # sorts before all, so that the first repository is one of the first owner
    whole = F.concat_ws(mark, group_key(owner), group_key(repository))
    each = found.select("__key", whole.alias("r"), F.explode("candidates.hash").alias("hash")).groupBy("__key", "hash").agg(F.min("r").alias("r"))
    each = each.groupBy("hash", "r").agg(F.count(F.lit(1)).alias("t")).groupBy("hash", F.substring_index("r", mark, 1).alias("o")).agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"))
    total = each.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners"), F.sum("t").alias("texts"))
    return total.withColumn("live", (F.col("owners") <= most_owners) | (F.col("repositories") <= most_repositories))


def judged(docs: DataFrame, source_col: str = "source", lang_col: str = "lang", most_owners: int = SECRET_OWNERS, most_repositories: int = SECRET_REPOSITORIES) -> DataFrame:
    """scan()'s rows with verdicts of the candidates, by start. Owner: the source; repository: its part in one language."""
    found = materialise(scan(docs.select("doc_id", "text", source_col, lang_col)))
    some = found.where(F.size("candidates") > 0)
    table = materialise(ownership(some, F.col(source_col), F.col(lang_col), most_owners, most_repositories))
    places = some.select("__key", F.explode("candidates").alias("c")).select("__key", "c.*").distinct()  # those of copies once
    hot = table.where(F.col("texts") > HOT_TEXTS)
    if 0 < hot.limit(HOT_HASHES + 1).count() <= HOT_HASHES:
        cold = places.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(table, "hash")
        found_places = cold.unionByName(places.join(F.broadcast(hot), "hash"))
    else:
        found_places = places.join(table, "hash")
    verdicts = found_places.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "token", "live", "owners", "repositories"))).alias("verdicts"))
    return found.drop("candidates").join(verdicts, "__key", "left").withColumn("verdicts", F.coalesce("verdicts", F.array().cast(VERDICT)))


def spans_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k, *_ in KINDS), F.lit("live"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, most_owners: int = SECRET_OWNERS, most_repositories: int = SECRET_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (base and live), n_live, n_example and ownership of each document.

    n_live and n_example count the candidates; ownership lists them as start:end:owners:repositories.
    """
    df = judged(docs, most_owners=most_owners, most_repositories=most_repositories)
    live = F.transform(F.filter("verdicts", lambda v: v["live"] & v["token"]), lambda v: F.struct(v["start"], F.lit(len(KINDS)).alias("kind"), v["end"]))
    spans = F.sort_array(F.concat(F.col("base"), live))
    n_live = F.size(F.filter("verdicts", lambda v: v["live"])).cast("long")
    owned = F.array_join(F.transform("verdicts", lambda v: F.concat_ws(":", v["start"], v["end"], v["owners"], v["repositories"])), ",")
    return df.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(spans).alias("spans"), n_live.alias("n_live"), (F.size("verdicts") - n_live).cast("long").alias("n_example"), owned.alias("ownership"))


def redact(docs: DataFrame, most_owners: int = SECRET_OWNERS, most_repositories: int = SECRET_REPOSITORIES, mark: str = "<secret>", broadcast_texts: int = 200_000) -> DataFrame:
    """docs with `mark` for each live-looking span: live tokens, and base spans that overlap no widely copied example.

    n_chars, if there is one, follows the text. Texts with spans are looked up in one pass if they are at most
    broadcast_texts; beyond that only documents in which a pattern occurs are joined with them.
    """
    df = judged(docs, most_owners=most_owners, most_repositories=most_repositories)
    example = lambda b: F.exists("verdicts", lambda v: ~v["live"] & (v["start"] < b["end"]) & (b["start"] < v["end"]))
    pair = lambda s: F.struct(s["start"], s["end"])
    marked = F.sort_array(F.concat(F.transform(F.filter("base", lambda b: ~example(b)), pair), F.transform(F.filter("verdicts", lambda v: v["live"] & v["token"]), pair)))
    spans = df.select("__key", marked.alias("__s")).where(F.size("__s") > 0).dropDuplicates(["__key"])
    # spans that touch or overlap become one
    last = lambda a: F.element_at(a, -1)
    merged = F.aggregate("__s", F.array().cast("array<struct<start:bigint,end:bigint>>"), lambda a, s: F.when((F.size(a) > 0) & (s["start"] <= F.get(a, F.size(a) - 1)["end"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(s))))
    spans = materialise(spans.select("__key", merged.alias("__s")))
    if spans.count() <= broadcast_texts:
        return _masked(docs, F.broadcast(spans), mark)
    maybe = F.lit(False)
    for pattern in (*(k[1] for k in KINDS), TOKEN):
        maybe = maybe | F.coalesce(F.col("text").rlike(pattern), F.lit(False))
    return docs.where(~maybe).unionByName(_masked(docs.where(maybe), spans, mark))


def _masked(docs: DataFrame, spans: DataFrame, mark: str) -> DataFrame:
    some = docs.withColumn("__key", text_key(F.coalesce(F.col("text"), F.lit("")))).join(spans, "__key", "left")
    before = lambda i: F.when(i > 0, F.get("__s", i - 1)["end"]).otherwise(0)
    pieces = F.transform("__s", lambda s, i: F.substring(F.col("text"), (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")))
    rest = F.substring(F.col("text"), (F.element_at("__s", -1)["end"] + 1).cast("int"), F.lit(2147483647))
    some = some.withColumn("text", F.when(F.col("__s").isNotNull(), F.concat(F.array_join(pieces, mark), F.lit(mark), rest)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        some = some.withColumn("n_chars", F.when(F.col("__s").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return some.select(docs.columns)
