"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates.

Equal shingle sets collapse to one node first, so groups of exact copies never meet again. The
remaining nodes get a one-permutation signature with optimal densification and one bucket key per
band. The best connected members of a bucket are the centres of stars, and every star edge is confirmed
on the full shingle sets before it links two nodes. The members of buckets that the stars leave in
several components are joined exactly, by prefixes of their rarest shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import lean, scratch_table, table, whole_text
from cohortlake.llm.components import connect
from cohortlake.llm.shingles import WordHashes, mix, shingle_set, words_of

BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS  # a power of two
SIGNED_SCHEMA = "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>"
SETS_SCHEMA = "node binary, shingles array<long>, cells binary"
COUNTED = 128  # cells of a set's outline
# Ranks of the star centres that each round adds to the buckets still open.
ROUNDS = ((1, 1), (2, 4), (5, 16))
CELLS = 1 << 18  # hashed shingle counts, which only order the shingles
HOLDERS = 2000  # of one shingle, in one part of the exact join


def _probes(tries: int = 1024) -> np.ndarray:
    """For each slot the order in which it looks for a filled one (fixed, the same for all sets)."""
    return np.random.default_rng(20_17).integers(0, SLOTS, (tries, SLOTS))


def band_keys(shingles: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """One bucket key per band from a set's one-permutation signature.

    The upper bits of a scrambled shingle name its slot, whose least value counts. An empty slot
    takes the value of the first filled slot in its own probe order, so that any two sets agree in
    each slot with the probability of their Jaccard similarity.
    """
    order = np.sort(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)))
    slots = (order >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
    filled, first = np.unique(slots, return_index=True)
    signature = np.zeros(SLOTS, dtype=np.uint64)
    signature[filled] = order[first]
    full = np.zeros(SLOTS, dtype=bool)
    full[filled] = True
    empty = np.nonzero(~full)[0]
    for row in probes:
        if not len(empty):
            break
        source = row[empty]
        hit = full[source]
        signature[empty[hit]] = signature[source[hit]]
        empty = empty[~hit]
    signature[empty] = signature[filled[0]]
    parts = signature.reshape(BANDS, ROWS)
    keys = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(ROWS):
        keys = mix(keys + parts[:, k])
    return keys.view(np.int64)


def node_of(shingles: np.ndarray) -> bytes:
    """128-bit identity of a shingle set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signed(docs: DataFrame, width: int, text: str, ident: str) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, bands) of every row; node is null for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, probes = WordHashes(), _probes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_set(hashes.of(words_of(t)), width) for t in part.column(2).to_pylist()]
                yield pa.record_batch(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([band_keys(s, probes) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "node", "bands"],
                )

    body = whole_text(text)
    rows = docs.select(
        F.col(ident).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.cast("binary").alias("text")
    )
    return rows.mapInArrow(lean(sign), SIGNED_SCHEMA)


def outline(shingles: np.ndarray) -> bytes:
    """Shingles counted in ``COUNTED`` cells: the sum of two sets' smaller counts bounds their intersection."""
    cells = (mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - COUNTED.bit_length() + 1)).astype(np.int64)
    return np.bincount(cells, minlength=COUNTED).astype(np.int32).tobytes()


def sets_of(docs: DataFrame, needed: DataFrame, width: int, text: str, ident: str) -> DataFrame:
    """(node, shingles, cells) of the documents that ``needed`` (doc_id, text_hash, node) names; doc_id may be null."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                nodes, sets = [], []
                for node, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    shingles = shingle_set(hashes.of(words_of(text)), width)
                    if node_of(shingles) == node:  # else another text with the same hash
                        nodes.append(node)
                        sets.append(shingles.view(np.int64))
                outlines = [outline(x.view(np.uint64)) for x in sets]
                yield pa.record_batch(
                    [pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64())), pa.array(outlines, pa.binary())],
                    names=["node", "shingles", "cells"],
                )

    whole = whole_text(text)
    body = docs.select(
        F.col(ident).cast("long").alias("number"), F.xxhash64(whole).alias("digest"), whole.cast("binary").alias("text")
    )
    same = F.col("number").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("text_hash"))
    return body.join(needed, same).select("node", "text").mapInArrow(lean(expand), SETS_SCHEMA).dropDuplicates(["node"])


def star_edges(members: DataFrame, ranks: tuple[int, int]) -> DataFrame:
    """(a, b) from each bucket's centres of these ranks to its members in other components.

    ``members`` has key, node, n_shingles, degree and component. Centres are the best connected
    members; their choice prunes in each map task, so a hot bucket never meets in one. Sizes that
    exclude the similarity exclude the edge.
    """
    best = Window.partitionBy("key").orderBy(F.col("degree").desc(), "node")
    centres = (
        members.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= ranks[1])
        .filter(F.col("rank") >= ranks[0])
        .select("key", F.col("node").alias("centre"), F.col("n_shingles").alias("size"), F.col("component").alias("other"))
    )
    fits = F.least("n_shingles", "size") * 100 >= F.greatest("n_shingles", "size") * F.col("percent")
    return (
        members.join(centres, "key")
        .filter((F.col("component") != F.col("other")) & fits)
        .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        .distinct()
    )


def possible(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges that the outlines of their sets do not exclude; half a kilobyte travels per end."""
    outlines = sets.select("node", "cells")
    near = edges.join(outlines.withColumnsRenamed({"node": "a", "cells": "ca"}), "a")
    near = near.join(outlines.withColumnsRenamed({"node": "b", "cells": "cb"}), "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.int32).reshape(-1, COUNTED) for i in (2, 3))
            common = np.minimum(left, right).sum(axis=1, dtype=np.int64)
            union = left.sum(axis=1, dtype=np.int64) + right.sum(axis=1, dtype=np.int64) - common
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(common * 100 >= union * percent)) for c in batch.columns[:2]], names=["a", "b"])

    return near.select("a", "b", "ca", "cb").mapInArrow(lean(keep), "a binary, b binary")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges whose full sets have ``100 * intersection >= percent * union``.

    Only edges that the outlines leave possible meet their full sets.
    """
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    likely = scratch_table(possible(edges, sets, percent), "likely")
    return likely.join(left, "a").join(right, "b").filter(common * 100 >= union * percent).select("a", "b")


def still_open(members: DataFrame, component: DataFrame, tested: int) -> DataFrame:
    """The members, with their component, of buckets of more than ``tested`` that span several components."""
    placed = members.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members")
    )
    still = split.filter((F.col("low") != F.col("high")) & (F.col("members") > tested)).select("key")
    return placed.join(still, "key")


def cells_of(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def prefixes(sets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """(node, component, size, shingle, position): the rarest shingles of each set of ``placed``.

    In one order of all shingles, rare ones first, two sets at the similarity bound share one of the
    first n - ceil(n * percent / 100) + 1. Counts are hashed into cells, equal ones go by value: any
    order is exact, a good one is fast.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            sums += np.bincount(cells_of(batch.column(0).flatten().to_numpy().view(np.uint64)), minlength=CELLS)
        at = np.nonzero(sums)[0]
        yield pa.record_batch([pa.array(at), pa.array(sums[at])], names=["cell", "n"])

    counted = sets.select("shingles").mapInArrow(lean(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, dtype=np.int64)
    counts[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = []
                for shingles in part.column(2):
                    values = shingles.values.to_numpy().view(np.uint64)
                    n = len(values)
                    order = np.lexsort((values, counts[cells_of(values)]))
                    found.append(values[order[: n + (-n * percent) // 100 + 1]])
                lengths = [len(f) for f in found]
                rows = pa.array(np.repeat(np.arange(part.num_rows), lengths))
                sizes = np.array([len(x.values) for x in part.column(2)], dtype=np.int64)
                yield pa.record_batch(
                    [
                        part.column(0).take(rows),
                        part.column(1).take(rows),
                        pa.array(np.repeat(sizes, lengths)),
                        pa.array(np.concatenate(found).view(np.int64)),
                        pa.array(np.concatenate([np.arange(n) for n in lengths]).astype(np.int64)),
                    ],
                    names=["node", "component", "size", "shingle", "position"],
                )

    rows = placed.join(sets, "node").select("node", "component", "shingles")
    return rows.mapInArrow(lean(cut), "node binary, component binary, size long, shingle long, position long")


def prefix_edges(rare: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of ``prefixes`` in two components that the bound does not exclude.

    Of two components one is not the largest among a shingle's holders, so only members outside the
    largest meet all holders; many holders are dealt to parts. Sizes and the places of the shingle
    bound the intersection; the first shingle that a pair shares never excludes a true link.
    """
    shares = rare.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"))
    several = shares.groupBy("shingle").agg(
        F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("holders"), F.count(F.lit(1)).alias("components")
    )
    several = several.filter("components > 1").select(
        "shingle", F.col("top.component").alias("largest"), F.ceil(F.col("holders") / HOLDERS).cast("int").alias("parts")
    )
    held = rare.join(several, "shingle")
    left = held.filter("component != largest").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    left = left.select("shingle", "part", *[F.col(c).alias(f"{c}_") for c in ("node", "component", "size", "position")])
    right = held.withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    rest = F.least(F.col("size") - F.col("position"), F.col("size_") - F.col("position_"))
    fits = rest * (100 + percent) >= (F.col("size") + F.col("size_")) * percent
    once = (F.col("component") == F.col("largest")) | (F.col("node_") < F.col("node"))
    return (
        left.join(right, ["shingle", "part"])
        .filter((F.col("component") != F.col("component_")) & once & fits)
        .select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    text: str = "text",
    ident: str = "doc_id",
    survivors: bool = False,
) -> DataFrame:
    """Each row of ``docs`` with doc_id, n_shingles, component_id and kept.

    With ``survivors`` the rows of ``docs`` themselves, one of each component and all of those
    without a shingle: the smallest identifier, then the least text hash; of rows that repeat both,
    one.

    Documents are linked if their sets of ``width``-word shingles have a Jaccard similarity of at
    least ``percent`` / 100; component_id is the smallest identifier reachable, kept marks it. A text
    with fewer words is one shingle. Null, empty and blank texts have no shingle and link to
    nothing; so their component is their own identifier. Rows with the same identifier stay apart
    unless their texts link; a null identifier is never the smallest unless it is alone. An empty
    table gives no rows.

    A pair at the similarity bound shares no bucket with a probability of (1 - 0.8**4)**32, about
    5e-8. Buckets stay open while their members lie in several components: the first round tests
    one star, later rounds further centres against other components only, which tests every pair of
    a bucket of up to 17 sets. All members of larger buckets that are still open then meet in an
    exact join, so every pair that shares a bucket is connected, tested or excluded by its bound.
    """
    base = scratch_table(signed(docs, width, text, ident), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    nodes = base.filter("node is not null").groupBy("node").agg(
        first, F.min("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
    )
    nodes = nodes.select("node", "first.doc_id", "first.text_hash", "n_shingles", "bands")
    keyed = nodes.select("node", "doc_id", "text_hash", "n_shingles", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = keyed.join(sizes, "key")
    degrees = shared.groupBy("node").agg(F.sum("members").alias("degree"))
    members = scratch_table(
        shared.drop("members").join(degrees, "node").withColumn("percent", F.lit(percent)), "buckets"
    )
    needed = members.groupBy("doc_id", "text_hash", "node").agg(F.lit(1).alias("one")).drop("one")
    sets = scratch_table(sets_of(docs, needed, width, text, ident), "sets")
    component = None
    for ranks in ROUNDS:
        open_ = members.withColumn("component", F.col("node")) if component is None else still_open(members, component, ranks[0])
        links = confirmed(star_edges(open_, ranks), sets, percent)
        component = connect(links, component, "component")
    left = still_open(members, component, ROUNDS[-1][1] + 1).select("node", "component").distinct()
    left = scratch_table(left, "open")
    if not left.isEmpty():
        rare = scratch_table(prefixes(sets, left, percent), "prefixes")
        component = connect(confirmed(prefix_edges(rare, percent), sets, percent), component, "component")
    ids = nodes.select("node", "doc_id").join(component, "node", "left")
    ids = ids.withColumn("component", F.coalesce("component", "node"))
    if survivors:
        return _survivors(docs, base, ids.select("node", "component"), text, ident)
    smallest = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = ids.join(smallest, "component").select("node", "component_id")
    return base.select("doc_id", "n_shingles", "node").join(labels, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def _survivors(docs: DataFrame, base: DataFrame, components: DataFrame, text: str, ident: str) -> DataFrame:
    key = ["__number", "__none", "__hash"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    # One row per distinct set first, so that a group of copies is small before it meets a component.
    least = base.filter("node is not null").groupBy("node").agg(first)
    least = least.join(components, "node").groupBy("component").agg(F.min("first").alias("first"))
    empty = base.filter("node is null").select("doc_id", "text_hash").distinct()
    chosen = least.select("first.doc_id", "first.text_hash", F.lit(False).alias("__empty")).unionByName(
        empty.withColumn("__empty", F.lit(True))
    )

    def keys(number, digest):
        return F.coalesce(number, F.lit(0)).alias("__number"), number.isNull().alias("__none"), digest.alias("__hash")

    chosen = chosen.select(*keys(F.col("doc_id"), F.col("text_hash")), "__empty")
    rows = docs.select("*", *keys(F.col(ident).cast("long"), F.xxhash64(whole_text(text)))).join(chosen, key)
    again = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    return rows.withColumn("__row", again).filter("__empty or __row = 1").select(*docs.columns)


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate component of every document, on two-word shingles."""
    return near_duplicates(table(spark, folder, "documents"), width=2)
