"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.session import checkpoint

MOST_STEPS = 60
# A key with more rows than this, and more than one in ``HOT_SHARE`` of all, is not left to one task.
HOT_ROWS, HOT_SHARE = 1 << 14, 1024


def with_unique(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, bound: int) -> DataFrame:
    """``rows`` joined to ``table``, which is unique by ``key``, without one task for a hot key.

    ``counts`` (key, n) says how many rows a key has, at least for the large ones. Keys with more than
    ``bound`` rows, which must be few, are broadcast.
    """
    hot = counts.filter(F.col("n") > bound).select(key)
    few = F.broadcast(table.join(F.broadcast(hot), key, "left_semi").withColumn("found", F.lit(True)))
    marked = rows.join(few, key, "left")
    known = marked.filter("found").drop("found")
    rest = marked.filter("found is null").select(*rows.columns).join(table, key)
    return known.unionByName(rest)


def _may_be_hot(total: int) -> bool:
    """Whether a key of ``total`` edges, each taken both ways, can have more than ``HOT_ROWS`` rows.

    If not, one window per star does with a single shuffle, and far fewer of the driver's threads and
    plans, what takes a keyed minimum and a join otherwise.
    """
    return 2 * total > HOT_ROWS


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not _may_be_hot(total):
        joined = both.withColumn("least", F.least("a", F.min("b").over(Window.partitionBy("a"))))
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n"))
    # The hub of a component is the smaller end of all its links, so it may have very many rows. Every
    # broadcast stays in the driver and the executors for a while, so there is none without such a hub.
    bound = max(HOT_ROWS, 2 * total // HOT_SHARE)
    least = checkpoint(least)
    hubs = least.agg(F.max("n")).first()[0] > bound
    table = least.select("a", F.least("a", "least").alias("least"))
    joined = with_unique(both, table, "a", least.select("a", "n"), bound) if hubs else both.join(table, "a")
    return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` point from the larger to the smaller end."""
    if not _may_be_hot(total):
        joined = edges.withColumn("least", F.min("b").over(Window.partitionBy("a")))
        end = F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b"))
        return joined.select(end.alias("a"), F.col("least").alias("b"))
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    joined = edges.join(least, "a").filter(F.col("b") != F.col("least"))
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
        least.select("a", F.col("least").alias("b"))
    )


def connect(links: DataFrame, known: DataFrame | None = None, name: str = "component") -> DataFrame:
    """(node, ``name``) for every node with a link: the least node of its component.

    ``links`` (a, b) may repeat and run either way; ``known`` is an earlier result to extend. Each
    step is a keyed minimum and a join, with partial minima before the shuffle (few links take a
    window instead), and is checkpointed; the number of steps grows with the logarithm of the longest
    path.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
    if known is not None:
        edges = edges.unionByName(known.select(F.col("node").alias("a"), F.col(name).alias("b")).filter("a != b"))
    edges = checkpoint(edges.distinct())
    before = None
    for _ in range(MOST_STEPS):
        total = edges.count() if before is None else before[0]
        edges = checkpoint(_small(_large(edges, total), total).distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            tips = edges.select(F.col("a").alias("node"), F.col("b").alias(name))
            return tips.unionByName(tips.select(F.col(name).alias("node"), name).distinct())
        before = state
    raise RuntimeError("components did not settle")
