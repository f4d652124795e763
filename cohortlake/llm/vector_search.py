"""Exact top-k inner products: KD-trees per shard, searched best box first.

A coarse KD-tree from a bounded sample deals the vectors to shards of neighbours; a shard with many
rows, such as copies of one vector, is split further by ranges of identifiers. Each query first
searches the shard it lies in. Its k-th score then goes along to the other shards, and only to those
whose bounding box can still reach it.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import scratch_table, table

LEAF = 64
ROW_SCHEMA = "shard string, kind int, id long, vector array<long>, kth long, kth_id long"
HIT_SCHEMA = "query_id long, id long, score long"


def integer_vectors(rows: DataFrame, ident: str, vector: str, scale: int) -> DataFrame:
    """(id, vector) with floor(scale * x) of each component; invalid vectors are left out.

    Null vectors and vectors with a null or non-finite component are invalid.
    """
    good = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.filter(F.coalesce(good, F.lit(False)) & F.col(ident).isNotNull()).select(
        F.col(ident).cast("long").alias("id"), whole.alias("vector")
    )


def exact_type(vectors: np.ndarray, other: np.ndarray) -> type:
    """float64 while every inner product is an exact integer in it, otherwise Python integers."""
    most = [float(np.abs(v.astype(float)).max()) if v.size else 0.0 for v in (vectors, other)]
    return float if most[0] * most[1] * max(1, vectors.shape[1]) < 2**52 else object


class Tree:
    """A KD-tree with median splits and tight boxes; rows are ordered by leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.children: list[tuple[int, int] | None] = []
        self.spans: list[tuple[int, int]] = []
        order = np.lexsort((ids,))
        pending, nodes = [(order, None)], []
        placed: list[np.ndarray] = []
        at = 0
        while pending:
            rows, parent = pending.pop()
            number = len(nodes)
            nodes.append(rows)
            self.children.append(None)
            self.spans.append((0, 0))
            if parent is not None:
                own = self.children[parent]
                self.children[parent] = (number, -1) if own is None else (own[0], number)
            part = vectors[rows]
            spread = part.max(axis=0) - part.min(axis=0) if part.shape[1] else np.zeros(1)
            if len(rows) <= LEAF:
                self.spans[number] = (at, at + len(rows))
                placed.append(rows)
                at += len(rows)
                continue
            if spread.max() > 0:
                rows = rows[np.argsort(part[:, int(np.argmax(spread))], kind="stable")]
            half = len(rows) // 2  # equal vectors split by identifier
            pending.append((rows[half:], number))
            pending.append((rows[:half], number))
        self.low = np.array([vectors[r].min(axis=0) for r in nodes])
        self.high = np.array([vectors[r].max(axis=0) for r in nodes])
        self.first = np.array([ids[r].min() for r in nodes])
        rows = np.concatenate(placed)
        self.ids, self.vectors = ids[rows], vectors[rows]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The greatest inner product that each box allows, for each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, kth: tuple) -> list[tuple]:
        """Up to ``k`` (score, -id) above ``kth``, best first; rows with id ``own`` are no candidates."""
        best: list[tuple] = []
        queue = [(-bounds[0], int(self.first[0]), 0)]
        while queue:
            bound, first, node = heapq.heappop(queue)
            if (-bound, -first) <= kth:
                break
            pair = self.children[node]
            if pair is not None:
                for child in pair:
                    heapq.heappush(queue, (-bounds[child], int(self.first[child]), child))
                continue
            start, end = self.spans[node]
            scores = self.vectors[start:end] @ query
            for i in np.nonzero(scores >= kth[0])[0]:
                ident = int(self.ids[start + i])
                item = (scores[i], -ident)
                if ident != own and item > kth:
                    (heapq.heappush if len(best) < k else heapq.heappushpop)(best, item)
                    if len(best) == k:
                        kth = max(kth, best[0])
        return sorted(best, reverse=True)


def router(sample: list[tuple[int, ...]], shards: int) -> list[tuple[int, float, int, int]]:
    """A coarse KD-tree over sampled vectors as (dimension, threshold, left, right); -1 ends at a shard."""
    nodes: list[tuple[int, float, int, int]] = []

    def grow(rows: np.ndarray, parts: int) -> int:
        spread = rows.max(axis=0) - rows.min(axis=0) if rows.size else np.zeros(1)
        number = len(nodes)
        nodes.append((-1, 0.0, -1, -1))
        if parts > 1 and len(rows) > 1 and spread.max() > 0:
            dim = int(np.argmax(spread))
            cut = float(np.median(rows[:, dim]))
            left = rows[:, dim] < cut
            if left.any() and not left.all():
                nodes[number] = (dim, cut, grow(rows[left], parts // 2), grow(rows[~left], parts - parts // 2))
        return number

    if sample:
        grow(np.array(sample, dtype=float), shards)
    return nodes


def route(vectors: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The coarse leaf of each row."""
    out = np.zeros(len(vectors), dtype=np.int64)
    if nodes:
        pending = [(0, np.arange(len(vectors)))]
        while pending:
            number, rows = pending.pop()
            dim, cut, left, right = nodes[number]
            if dim < 0:
                out[rows] = number
            elif len(rows):
                less = vectors[rows, dim] < cut
                pending += [(left, rows[less]), (right, rows[~less])]
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def exact_top_k(
    rows: DataFrame,
    k: int = 5,
    ident: str = "vec_id",
    vector: str = "embedding",
    every: int = 50,
    scale: int = 256,
    shard_rows: int = 8192,
    sample_rows: int = 20_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all other rows for each query.

    Queries are the rows whose identifier is divisible by ``every``; candidates are all rows but
    those with the query's identifier. The score is the integer inner product; ties go to smaller
    identifiers. Vectors are compared with those of their own width only. Invalid vectors and rows
    without an identifier take no part; repeated rows each count. With fewer candidates than ``k``
    all are returned, and an empty table gives no rows. Scores beyond a long raise.

    ``shard_rows`` bounds what a task holds, ``sample_rows`` the sample that shapes the shards; the
    shards have no influence on the result.
    """
    spark = rows.sparkSession
    valid = integer_vectors(rows, ident, vector, scale)
    widths = valid.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("rows")).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    results = [_of_width(valid.filter(F.size("vector") == w.width), w, k, every, shard_rows, sample_rows) for w in widths]
    merged = results[0]
    for more in results[1:]:
        merged = merged.unionByName(more)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _of_width(valid: DataFrame, size, k: int, every: int, shard_rows: int, sample_rows: int) -> DataFrame:
    width, leaves = size.width, max(1, -(-size.rows // shard_rows))
    drawn = valid.orderBy(F.xxhash64("id", "vector")).limit(sample_rows).select("vector").collect()
    nodes = router([tuple(r.vector) for r in drawn], leaves)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = route(matrix(batch.column(1), width), nodes)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(leaf)], names=["id", "vector", "leaf"])

    dealt = valid.mapInArrow(deal, "id long, vector array<long>, leaf long")
    # Identifier ranges split a leaf with more rows than a shard may have: as many cuts as shards.
    cuts = dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("low"), F.max("id").alias("high"))
    step = F.floor((F.col("high") - F.col("low")) / F.ceil(F.col("rows") / F.lit(shard_rows))) + 1
    cuts = cuts.select("leaf", "low", step.alias("step"))
    shards = dealt.join(cuts, "leaf").select(
        F.concat_ws("-", "leaf", F.floor((F.col("id") - F.col("low")) / F.col("step"))).alias("shard"), "id", "vector"
    )
    shards = scratch_table(shards, "shards")

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            names, ids, vectors = np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy(), matrix(batch.column(2), width)
            for name in np.unique(names):
                own = names == name
                now = [vectors[own].min(axis=0), vectors[own].max(axis=0), int(ids[own].min())]
                was = found.get(name, now)
                found[name] = [np.minimum(was[0], now[0]), np.maximum(was[1], now[1]), min(was[2], now[2])]
        lists = [[v[0].tolist() for v in found.values()], [v[1].tolist() for v in found.values()]]
        columns = [pa.array(list(found), pa.string()), *[pa.array(x, pa.list_(pa.int64())) for x in lists]]
        yield pa.record_batch([*columns, pa.array([v[2] for v in found.values()], pa.int64())], names=["shard", "low", "high", "first"])

    # A box per shard and task; the boxes of all shards are 1/shard_rows of the vectors or less.
    partial = shards.mapInArrow(box, "shard string, low array<long>, high array<long>, first long")
    ends = [F.min(F.get("low", F.lit(d))).alias(f"l{d}") for d in range(width)]
    ends += [F.max(F.get("high", F.lit(d))).alias(f"h{d}") for d in range(width)]
    boxes = partial.groupBy("shard").agg(*ends, F.min("first").alias("first")).collect()
    names = [b.shard for b in boxes]
    low = np.array([[b[f"l{d}"] for d in range(width)] for b in boxes]).reshape(len(boxes), width)
    high = np.array([[b[f"h{d}"] for d in range(width)] for b in boxes]).reshape(len(boxes), width)
    first = np.array([b["first"] for b in boxes], dtype=np.int64)
    known = spark_broadcast(valid, (names, low, high, first))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard: vectors (kind 0) build its tree, queries (kind 1) behind them search."""
        tree, building, current = None, [], None
        for batch in batches:
            shard_of, kinds = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            ids, vectors = batch.column(2).to_numpy(), matrix(batch.column(3), width)
            kth = list(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True))
            at = 0
            for (shard, kind), group in itertools.groupby(zip(shard_of, kinds.tolist(), strict=True)):
                end = at + sum(1 for _ in group)
                if shard != current:
                    tree, building, current = None, [], shard
                if kind == 0:
                    building.append((ids[at:end], vectors[at:end]))
                elif building:
                    if tree is None or isinstance(tree, type):
                        every_id = np.concatenate([b[0] for b in building])
                        every_vector = np.concatenate([b[1] for b in building])
                    for b in range(at, end, 256):
                        part = vectors[b : min(end, b + 256)]
                        kind_of = exact_type(every_vector, part)
                        if tree is None or tree.vectors.dtype != np.dtype(kind_of):
                            tree = Tree(every_id, every_vector.astype(kind_of))
                        bounds = tree.bounds(part.astype(kind_of))
                        out = []
                        for i in range(len(part)):
                            score, ident = kth[b + i]
                            least = (-float("inf"), 0) if score is None else (score, -ident)
                            query = int(ids[b + i])
                            found = tree.search(part[i].astype(kind_of), bounds[i], query, k, least)
                            out.extend((query, -negative, int(value)) for value, negative in found)
                        columns = [pa.array([o[c] for o in out], pa.int64()) for c in range(3)]
                        yield pa.record_batch(columns, names=["query_id", "id", "score"])
                at = end

    def searched(asked: DataFrame) -> DataFrame:
        """Hits of (shard, id, vector, kth, kth_id) queries in their shards."""
        nothing = F.lit(None).cast("long")
        data = shards.select("shard", F.lit(0).alias("kind"), "id", "vector", nothing.alias("kth"), nothing.alias("kth_id"))
        both = data.unionByName(asked.withColumn("kind", F.lit(1)).select(*data.columns))
        return both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(look, HIT_SCHEMA)

    queries = shards.filter(F.col("id") % every == 0)
    nothing = F.lit(None).cast("long")
    home = scratch_table(searched(queries.select("*", nothing.alias("kth"), nothing.alias("kth_id"))), "home")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    last = home.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k)
    reached = queries.join(
        last.select(F.col("query_id").alias("id"), F.col("score").alias("kth"), F.col("id").alias("kth_id")), "id", "left"
    )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every other shard whose box can still hold one of its best."""
        names, low, high, first = known.value
        names = np.array(names)
        for batch in batches:
            homes, ids, vectors = batch.column(0).to_pylist(), batch.column(1), matrix(batch.column(2), width)
            kind_of = exact_type(np.vstack([low, high]), vectors)
            asked = vectors.astype(kind_of)
            bounds = np.maximum(asked, 0) @ high.T.astype(kind_of) + np.minimum(asked, 0) @ low.T.astype(kind_of)
            kths = list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True))
            for i, (shard, (score, ident)) in enumerate(zip(homes, kths, strict=True)):
                open_ = names != shard
                if score is not None:
                    open_ &= (bounds[i] > score) | ((bounds[i] == score) & (first < ident))
                n = int(open_.sum())
                if n:
                    vector = pa.array([vectors[i].tolist()] * n, pa.list_(pa.int64()))
                    same = [pa.array([x] * n, pa.int64()) for x in (ids[i].as_py(), score, ident)]
                    columns = [pa.array(names[open_].tolist(), pa.string()), same[0], vector, same[1], same[2]]
                    yield pa.record_batch(columns, names=["shard", "id", "vector", "kth", "kth_id"])

    asked = reached.select("shard", "id", "vector", "kth", "kth_id").mapInArrow(
        visit, "shard string, id long, vector array<long>, kth long, kth_id long"
    )
    return home.unionByName(searched(asked))


def spark_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def op3_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five best neighbours of every fiftieth vector."""
    return exact_top_k(table(spark, folder, "embeddings"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
