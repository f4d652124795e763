"""Neighbour-based mutual information of numeric features with a label, by value ranges.

Equal values collapse to one cell with a count first. The cells of a feature are dealt to ranges of
bounded size; each range gets the nearest cells on both sides as a halo, so neighbours are found
inside ranges. Counts within a radius are differences of running counts, stitched from range totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.session import checkpoint, sized

RANGE_CELLS = 50_000


def digamma(n: Column) -> Column:
    """Digamma of a positive integer column, to about 12 digits: six recurrences, then its series."""
    x = n.cast("double") + 6.0
    inverse = 1.0 / (x * x)
    series = F.ln(x) - 0.5 / x - inverse * (
        1.0 / 12 - inverse * (1.0 / 120 - inverse * (1.0 / 252 - inverse * (1.0 / 240 - inverse / 132)))
    )
    return series - sum((1.0 / (n + i) for i in range(6)), F.lit(0.0))


def ranged(cells: DataFrame, feature: str) -> tuple[DataFrame, DataFrame]:
    """``(feature, edges)``: cut points that deal each feature's values to ranges, and the cells with their range.

    Cut points come from a sketch; any points are right, good ones keep ranges even.
    """
    most = cells.groupBy(feature).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // RANGE_CELLS))
    points = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else None
    cut = F.array_distinct(F.percentile_approx("value", points, 10_000)) if parts > 1 else F.array().cast("array<double>")
    edges = sized(cells.groupBy(feature).agg(cut.alias("edges")))
    return edges, with_range(cells, edges, feature, "value")


def with_range(rows: DataFrame, edges: DataFrame, feature: str, value: str) -> DataFrame:
    """Add the number of the range that holds ``value``: how many edges lie below it."""
    below = F.size(F.filter("edges", lambda e: e < F.col(value)))
    return rows.join(edges, feature).withColumn("range", below).drop("edges")


def with_halo(cells: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The cells of every range, and the ``k`` cells before and behind it, marked ``halo``.

    Only the outer cells of ranges, 2 k each, are put in one order per group to find the halos.
    """
    own = Window.partitionBy(*keys, "range")
    ends = cells.withColumn("up", F.row_number().over(own.orderBy("value"))).withColumn(
        "down", F.row_number().over(own.orderBy(F.desc("value")))
    )
    ends = ends.filter((F.col("up") <= k) | (F.col("down") <= k))
    line = Window.partitionBy(*keys).orderBy("value")
    cell = F.struct("value", "n")
    halos = ends.withColumn("before", F.collect_list(cell).over(line.rowsBetween(-k, -1))).withColumn(
        "behind", F.collect_list(cell).over(line.rowsBetween(1, k))
    )
    none = F.array().cast("array<struct<value:double,n:bigint>>")
    halos = halos.filter((F.col("up") == 1) | (F.col("down") == 1)).withColumn(
        "halo", F.concat(F.when(F.col("up") == 1, F.col("before")).otherwise(none), F.when(F.col("down") == 1, F.col("behind")).otherwise(none))
    )
    extra = halos.select(*keys, "range", F.inline("halo")).withColumn("halo", F.lit(True))
    columns = [*keys, "range", "value", "n"]
    return cells.select(*columns).withColumn("halo", F.lit(False)).unionByName(extra.select(*columns, "halo"))


def radii(cells: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Each cell with ``radius``: the distance of its points to their ``need``-th neighbour of the same keys.

    ``cells`` has the keys, range, value, n and ``need``, constant per keys and at most ``k``.
    """
    spread = with_halo(cells, keys, k)
    line = Window.partitionBy(*keys, "range").orderBy("value")
    cell = F.struct("value", "n")
    seen = spread.withColumn(
        "near", F.concat(F.collect_list(cell).over(line.rowsBetween(-k, -1)), F.collect_list(cell).over(line.rowsBetween(1, k)))
    ).filter("not halo")
    needs = cells.select(*keys, "need").distinct()
    seen = seen.join(needs, keys)
    away = F.array_sort(F.transform("near", lambda c: F.struct(F.abs(c["value"] - F.col("value")).alias("d"), c["n"].alias("n"))))
    start = F.struct((F.col("n") - 1).alias("have"), F.lit(0.0).alias("radius"))

    def step(acc: Column, c: Column) -> Column:
        more = acc["have"] < F.col("need")
        return F.struct(
            F.when(more, acc["have"] + c["n"]).otherwise(acc["have"]).alias("have"),
            F.when(more, c["d"]).otherwise(acc["radius"]).alias("radius"),
        )

    return seen.withColumn("radius", F.aggregate(away, start, step)["radius"]).select(*keys, "value", "n", "need", "radius")


def counts_within(cells: DataFrame, points: DataFrame, edges: DataFrame, feature: str, keys: list[str]) -> DataFrame:
    """Each cell of ``(keys, value, n, need, radius)`` with ``m``: the points of all labels nearer than its radius.

    A point itself counts; where the radius is 0, the points of equal value do. Every cell asks for
    two running counts; questions and points are sorted together within ranges, and the totals of the
    ranges before are added.
    """
    low, high = F.col("value") - F.col("radius"), F.col("value") + F.col("radius")
    tied = F.col("radius") == 0
    # kind 0 asks for the points below, kind 2 for those up to; points themselves are kind 1.
    asks = F.array(
        F.struct(F.when(tied, F.col("value")).otherwise(low).alias("at"), F.when(tied, 0).otherwise(2).alias("kind"), F.lit(-1).alias("sign")),
        F.struct(F.when(tied, F.col("value")).otherwise(high).alias("at"), F.when(tied, 2).otherwise(0).alias("kind"), F.lit(1).alias("sign")),
    )
    questions = cells.select(*keys, "value", F.inline(asks), F.lit(0).cast("long").alias("count"))
    others = [c for c in keys if c != feature]
    given = points.select(
        feature, F.col("value").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("sign"), F.col("n").cast("long").alias("count")
    )
    events = with_range(questions.unionByName(given, allowMissingColumns=True), edges, feature, "at")
    totals = with_range(points, edges, feature, "value").groupBy(feature, "range").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.partitionBy(feature).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select(feature, "range", F.coalesce(before, F.lit(0)).alias("base"), "total")
    last = bases.groupBy(feature).agg(F.array_sort(F.collect_list(F.struct("range", "base", "total"))).alias("bases"))
    running = F.sum("count").over(Window.partitionBy(feature, "range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    counted = events.withColumn("running", running).filter("sign <> 0").join(last, feature)
    # Points in earlier ranges; a range without a point has no row of its own.
    base = F.aggregate(
        F.filter("bases", lambda b: b["range"] < F.col("range")), F.lit(0).cast("long"), lambda s, b: s + b["total"]
    )
    found = counted.withColumn("seen", (F.col("running") + base) * F.col("sign"))
    sums = found.groupBy(feature, *others, "value").agg(F.sum("seen").alias("m"))
    return cells.join(sums, [*keys, "value"])


def neighbour_information(long: DataFrame, label: str, k: int = 3, feature: str = "feature") -> DataFrame:
    """``(feature, n, mutual_information, rank)`` of ``(label, feature, value)`` rows, natural log.

    The estimator for a numeric feature and a discrete label: for each point, the distance to its
    ``k``-th neighbour of the same label, and the number m of points of any label nearer than that;
    the information is digamma(n) + mean digamma(k) - mean digamma(label size) - mean digamma(m), not
    below 0. A label of k points or fewer uses the neighbours it has; one of a single point takes
    no part. Distances that tie are compared as computed: m counts points strictly between value - radius
    and value + radius, or of equal value where the radius is 0. No noise is added, so the result is
    reproducible; many equal values are many neighbours at distance 0. Null and NaN values and null
    labels take no part; a feature without a usable point has no row.
    """
    rows = long.select(F.col(feature).alias("feature"), F.col(label).alias("label"), F.col("value").cast("double").alias("value"))
    rows = rows.filter("feature is not null and label is not null and value is not null and not isnan(value)")
    cells = checkpoint(rows.groupBy("feature", "label", "value").agg(F.count(F.lit(1)).alias("n")))
    sizes = cells.groupBy("feature", "label").agg(F.sum("n").alias("size")).filter("size > 1")
    usable = cells.join(sized(sizes), ["feature", "label"])
    edges, placed = ranged(usable, "feature")
    placed = placed.withColumn("need", F.least(F.lit(k), F.col("size") - 1))
    near = checkpoint(radii(placed, ["feature", "label"], k))
    points = near.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    counted = counts_within(near, points, edges, "feature", ["feature", "label"]).join(sizes, ["feature", "label"])
    n = F.col("n")
    facts = counted.groupBy("feature").agg(
        F.sum("n").alias("n"),
        F.sum(n * (digamma(F.col("need")) - digamma(F.col("size")) - digamma(F.col("m")))).alias("sum"),
    )
    value = digamma(F.col("n")) + F.col("sum") / F.col("n")
    scores = facts.select("feature", "n", F.greatest(F.lit(0.0), F.round(value, 10)).alias("mutual_information"))
    # One row per feature from here on.
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mutual_information"), "feature")))
