"""Reachability: a frontier loop over the graph of catalogs.

Every round joins the frontier with the edges, drops what was visited, and writes its new nodes to the shared
folder. Rounds are as many as the graph is deep; all roots start together, so that shared subtrees are walked once.
What was visited is kept in tables of rising size, as many as the logarithm of the rounds, so that deep graphs cost no more a round.
A catalog that the graph reaches but that could not be read ends the run: nothing below it may look unreachable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.session import materialise, release


class MissingCatalogs(RuntimeError):
    """Catalogs are named but can't be read."""


class Visited:
    """Tables of nodes; a table that has come to half the size of the one before is joined with it."""

    def __init__(self, first: DataFrame):
        self.tables = [(first, first.count())]

    def add(self, table: DataFrame) -> int:
        n = table.count()
        if n:
            self.tables.append((table, n))
        while len(self.tables) > 1 and 2 * self.tables[-1][1] >= self.tables[-2][1]:
            (a, x), (b, y) = self.tables[-2:]
            self.tables[-2:] = [(materialise(a.unionByName(b)), x + y)]
            # the frontier is still read by the next round
            release(a, *([b] if b is not table else []))
        return n

    def all(self) -> DataFrame:
        out = self.tables[0][0]
        for t, _ in self.tables[1:]:
            out = out.unionByName(t)
        return out


def walk(roots: DataFrame, children: Callable[[DataFrame], DataFrame], pruned: DataFrame | None = None) -> DataFrame:
    """hash and depth of every node reached from roots (hash). children: frontier (hash) to child (hash), in any number.

    Nodes in pruned (hash) are not visited, nor what only they lead to.
    """
    skip = pruned.select("hash") if pruned is not None else None
    frontier = roots.select("hash").distinct()
    if skip is not None:
        frontier = frontier.join(skip, "hash", "left_anti")
    frontier = materialise(frontier.withColumn("depth", F.lit(0)))
    visited, depth = Visited(frontier), 0
    more = visited.tables[0][1]
    while more:
        depth += 1
        found = children(frontier.select("hash")).select("hash").distinct().join(visited.all().select("hash"), "hash", "left_anti")
        if skip is not None:
            found = found.join(skip, "hash", "left_anti")
        frontier = materialise(found.withColumn("depth", F.lit(depth)))
        more = visited.add(frontier)
    return visited.all()


def mark_reading(roots: DataFrame, read: Callable[[DataFrame], DataFrame], pruned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Visited catalogs, and what they name (catalog_hash, kind, hash, suffix); each catalog is read once.

    read: frontier (hash) to the rows of these catalogs; rows of kind `nested` are children.
    """
    named: list[DataFrame] = []

    def step(frontier: DataFrame) -> DataFrame:
        named.append(materialise(read(frontier)))
        return named[-1].where("kind = 'nested'").select("hash")

    visited = walk(roots, step, pruned)
    out = named[0] if named else materialise(read(visited.select("hash").limit(0)))
    for n in named[1:]:
        out = out.unionByName(n)
    return visited, out


def named_entries(visited: DataFrame, roots: DataFrame, named: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The bag of entries of mark_reading()'s rows: each root once, each edge, each reference; no seen catalogs."""
    catalogs = roots.select("hash").distinct().join(visited.select("hash"), "hash", "left_semi").unionAll(named.where("kind = 'nested'").select("hash"))
    if seen is not None:
        catalogs = catalogs.join(seen.select("hash"), "hash", "left_anti")
    return catalogs.withColumn("suffix", F.lit("C")).unionByName(named.where("kind != 'nested'").select("hash", "suffix"))


def counts(roots: DataFrame, visited: DataFrame, edges: DataFrame, refs: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row: catalogs started, processed, skipped (named again, or pruned), and entries emitted."""
    own = visited.select("hash")
    named = roots.select("hash").unionAll(edges.join(own, edges["parent"] == own["hash"], "left_semi").select(F.col("child").alias("hash")))
    lost = failed.select("hash").distinct() if failed is not None else own.limit(0)
    content = refs.join(own.withColumnRenamed("hash", "catalog_hash"), "catalog_hash", "left_semi")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = one(own, "started").crossJoin(one(own.join(lost, "hash", "left_anti"), "processed"))  # of one row each
    out = out.crossJoin(one(named, "named")).crossJoin(one(content, "content"))
    edges_out = edges.join(own, edges["parent"] == own["hash"], "left_semi")
    out = out.crossJoin(one(edges_out, "edges")).crossJoin(one(roots.select("hash").distinct().join(own, "hash", "left_semi"), "roots"))
    return out.select("started", "processed", (F.col("named") - F.col("started")).alias("skipped"), (F.col("roots") + F.col("edges") + F.col("content")).alias("emitted"))


def by_edges(edges: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return lambda frontier: edges.join(frontier, edges["parent"] == frontier["hash"], "left_semi").select(F.col("child").alias("hash"))


def mark(roots: DataFrame, edges: DataFrame, catalogs: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Catalogs reached from roots; with seen, only what is new. catalogs: those that were read, if that is to be checked."""
    visited = walk(roots, by_edges(edges), seen)
    if catalogs is not None:
        lost = visited.join(catalogs.select("hash"), "hash", "left_anti")
        if few := lost.limit(5).collect():
            raise MissingCatalogs(f"can't be read: {', '.join(r['hash'] for r in few)}")
    return visited


def emitted(visited: DataFrame, roots: DataFrame, edges: DataFrame, refs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The bag of entries that visited catalogs name: each root once, each edge, each reference; no seen catalogs."""
    own = visited.select("hash")
    catalogs = roots.select("hash").distinct().join(own, "hash", "left_semi").unionAll(edges.join(own, edges["parent"] == own["hash"], "left_semi").select(F.col("child").alias("hash")))
    if seen is not None:
        catalogs = catalogs.join(seen.select("hash"), "hash", "left_anti")
    content = refs.join(own.withColumnRenamed("hash", "catalog_hash"), "catalog_hash", "left_semi").select("hash", "suffix")
    return catalogs.withColumn("suffix", F.lit("C")).unionByName(content)


def mark_fetching(roots: DataFrame, children: Callable[[DataFrame], DataFrame], processed: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Visited catalogs and those that failed. fetch: frontier (hash) to hash and ok, run before children are read.

    Processed catalogs are skipped with all below them. The caller adds visited to processed only if none failed.
    """
    failed: list[DataFrame] = []

    def step(frontier: DataFrame) -> DataFrame:
        got = materialise(fetch(frontier))
        failed.append(got.where(~F.col("ok")).select("hash"))
        return children(got.where("ok").select("hash"))

    visited = walk(roots, step, processed)
    lost = visited.select("hash").limit(0)
    for f in failed:
        lost = lost.unionAll(f)
    return visited, lost
