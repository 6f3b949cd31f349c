"""URL filters: rules as intervals of canonical keys, found by a sort-merge range join with a stack.

A rule is a host and a path prefix. Its key is the host's labels in reverse order, an end mark and the path; the
urls that begin with it form an interval of keys. A url is looked for under its own host and each parent domain,
so that a rule fits subdomains too. Keys and rules are sorted and merged in one sweep: a stack holds the rules whose
interval is open, each nested in the one below, and its top is the longest that fits.

Rules are a table. Up to `broadcast_rules` of them are sent to executors, sorted, and each Arrow batch of keys is
sorted and swept; nothing is shuffled. Beyond that the distinct hosts and paths are joined with the rules by ranges:
keys under hosts that have rules are dealt with these by host, hosts of many keys into parts with the rules in each,
sorted, and swept in a stream that holds nothing but the stack. The longest rule of a url counts, by the length of host and path,
then by name.

A null url or one without `://` has an empty host and path and gets the default verdict. Repeated rows are judged
each; equal rules count once, and `block` wins over `allow`; rules with a null in them are none. Hosts are compared
in lower case.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.session import materialise


#: Below any character of a host or path, so that a host sorts before its subdomains.
END, LABEL = "\x00", "\x01"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host (A-Z in lower case) and path; null urls and urls without :// have both empty."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    part = lambda k: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return pages.withColumn("host", F.translate(part(1), UPPER, UPPER.lower())).withColumn("path", part(2))


def reversed_host(host: str) -> str:
    return LABEL.join(reversed(host.split(".")))


def sweep(keys: list[str], rules: list[str]) -> list[int]:
    """For each of the sorted keys the longest of the sorted rules that it begins with, as an index, or -1."""
    out, stack, at = [], [], 0
    for key in keys:
        while stack and not key.startswith(rules[stack[-1]]):
            stack.pop()
        if not stack and at < len(rules) and rules[at] < key:
            # no rule is open: rules that end before this key's first character's group can be passed over
            at = max(at, bisect_left(rules, key[: key.find(END) + 1] if END in key else key, at))
        while at < len(rules) and rules[at] <= key:
            if key.startswith(rules[at]):
                stack.append(at)
            at += 1
        out.append(stack[-1] if stack else -1)
    return out


Rules = DataFrame | list[tuple[str, str, str]] | tuple[tuple[str, str, str], ...]


def rule_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """verdict, rule_host and rule_path, once each; rules: a table (verdict, host, path) or such tuples."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    named = rules.select("verdict", F.translate("host", UPPER, UPPER.lower()).alias("rule_host"), F.col("path").alias("rule_path")).dropna()
    return named.groupBy("rule_host", "rule_path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict"))["verdict"].alias("verdict"))


def judge(pages: DataFrame, rules: Rules, url_col: str = "url", default: str = "allow", broadcast_rules: int = 200_000, split_keys: int = 1_000_000) -> DataFrame:
    """Add host, path, rule and verdict to pages, in place of columns of these names. rules: verdict, host, path prefix."""
    base = with_host_and_path(pages, url_col)
    names = [c for c in base.columns if c not in ("rule", "verdict")]
    base = base.select(names)
    table = rule_table(pages.sparkSession, rules)
    found = table.limit(broadcast_rules + 1).collect()
    if len(found) <= broadcast_rules:
        return _in_batches(base, [tuple(r) for r in found], default)
    best = _by_ranges(base.select("host", "path").distinct(), table, split_keys)
    return base.join(best, ["host", "path"], "left").select(*names, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _in_batches(pages: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """Add rule and verdict; rules (host, path, verdict) are broadcast."""
    ordered = sorted((reversed_host(host) + END + path, host + path, verdict) for host, path, verdict in rules)
    sent = pages.sparkSession.sparkContext.broadcast(([x[0] for x in ordered], ordered))
    at = [pages.columns.index(k) for k in ("host", "path")]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ordered = sent.value
        for batch in batches:
            probes = []
            for row, (host, path) in enumerate(zip(*(batch.column(i).to_pylist() for i in at), strict=True)):
                if host:
                    labels, key = host.split("."), ""
                    for n, label in enumerate(reversed(labels)):
                        key = f"{key}{LABEL}{label}" if n else label
                        probes.append((key + END + path, row))
            probes.sort()
            best: list[tuple | None] = [None] * batch.num_rows
            for (_, row), k in zip(probes, sweep([p[0] for p in probes], keys), strict=True):
                if k >= 0 and (best[row] is None or (len(ordered[k][1]), ordered[k][1]) > best[row][:2]):
                    best[row] = (len(ordered[k][1]), *ordered[k][1:])
            more = [pa.array([b and b[1] for b in best], pa.string()), pa.array([b[2] if b else default for b in best], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "rule", "verdict"])

    return pages.mapInArrow(judged, T.StructType([*pages.schema, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))


def _by_ranges(urls: DataFrame, rules: DataFrame, split_keys: int) -> DataFrame:
    """host, path, rule and verdict of those distinct urls (host, path) that a rule fits."""
    rules = materialise(rules)
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = urls.where("host != ''").select("host", "path", F.explode(F.array_distinct(parents)).alias("rule_host"))
    keys = materialise(keys.join(rules.select("rule_host").distinct(), "rule_host", "left_semi"))
    # a host of many keys is worked on in parts, each with all rules of the host
    parts = keys.groupBy("rule_host").agg(F.count(F.lit(1)).alias("n")).select("rule_host", F.ceil(F.col("n") / split_keys).cast("int").alias("parts"))
    parts = materialise(parts)
    mine = keys.join(parts, "rule_host").select("rule_host", F.pmod(F.xxhash64("path"), "parts").cast("int").alias("part"), F.col("path").alias("at"), F.lit(1).alias("kind"), "host", F.lit(None).cast("string").alias("verdict"))
    theirs = rules.join(parts, "rule_host").select("rule_host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("rule_path").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "verdict")
    dealt = mine.unionByName(theirs).repartition("rule_host", "part").sortWithinPartitions("rule_host", "part", "at", "kind")

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stack = None, []
        for batch in batches:
            out = []
            for rule_host, part, at, kind, host, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (rule_host, part):
                    group, stack = (rule_host, part), []
                while stack and not at.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((at, verdict))
                elif stack:
                    out.append((host, at, rule_host + stack[-1][0], stack[-1][1]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], ["host", "path", "rule", "verdict"])

    found = dealt.mapInArrow(swept, "host string, path string, rule string, verdict string")
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("b"))
    return best.select("host", "path", "b.rule", "b.verdict")
