import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlake.functions import embedders
from cohortlake.functions import sequence as seq
from cohortlake.plans import jobs


def sized():
    """A model that says of each text its length, the size of its batch and the spread of lengths there."""

    def open_model():
        opened = np.random.default_rng().integers(1 << 22)

        def model(texts):
            lengths = [len(t) for t in texts]
            return np.array([[n, len(texts), max(lengths) - min(lengths), opened] for n in lengths], dtype=float)

        return model

    return open_model


def test_batches_and_order(spark):
    embedders.register_batch_embedder("Sized", 4, sized())
    rows = [(f"s{i:04d}", "A" * (i * 37 % 101)) for i in range(1000)]
    df = spark.createDataFrame(rows, "seq_id string, sequence string").coalesce(3)
    vectors = embedders.with_vectors(df, "sequence", embedders.embedder("sized"), 16)
    parts = vectors.select("*", F.spark_partition_id().alias("part")).collect()
    before = df.select("seq_id", F.spark_partition_id().alias("part")).collect()
    for part in range(3):
        own = [r for r in parts if r.part == part]
        assert [r.seq_id for r in own] == [r.seq_id for r in before if r.part == part]
        assert all(len(r.sequence) == r.embedding[0] and r.embedding[1] <= 16 for r in own)
        assert sum(r.embedding[1] < 16 for r in own) < 16  # only the last batch of a pool is smaller
        assert len({r.embedding[3] for r in own}) == 1  # opened once in a task
        assert np.mean([r.embedding[2] for r in own]) < 12  # similar lengths together


def test_jobs_take_a_batch_size(spark):
    embedders.register_batch_embedder("Sized", 4, sized())
    df = spark.createDataFrame([("a", "MKV"), ("b", None), ("c", ""), ("d", "MK"), ("d", "MK")], "seq_id string, sequence string")
    for batch in (1, 2, 64):
        found = jobs.embed(df.coalesce(1), "sized", batch).collect()
        assert [(r.seq_id, r.length, r.dim, r.embedding[0]) for r in found] == [
            ("a", 3, 4, 3.0), ("b", None, 4, 0.0), ("c", 0, 4, 0.0), ("d", 2, 4, 2.0), ("d", 2, 4, 2.0)
        ]
        assert max(r.embedding[1] for r in found) == min(batch, 5)
    assert jobs.embed(df.limit(0), "sized").count() == 0
    with pytest.raises(ValueError, match="at least one text"):
        jobs.embed(df, "sized", 0)


def test_model_may_name_the_module_of_used_columns(spark):
    df = spark.createDataFrame([("a", "MKM"), ("b", None)], "seq_id string, sequence string")
    used = df.select(seq.composition("sequence"), seq.letters_only("sequence"), seq.sanitized("sequence"))
    assert used.count() == 2 and seq.pattern_positions(df, ["seq_id"], "sequence", ["M"]).count() == 2

    def open_model():
        return lambda texts: seq.byte_counts(pa.array(texts, pa.large_string()))[:, [ord("M")]]

    chosen = embedders.Embedder("counts", 1, open_model=open_model)
    found = embedders.with_vectors(df, "sequence", chosen).collect()
    assert sorted((r.seq_id, r.embedding) for r in found) == [("a", [2.0]), ("b", [0.0])]


def test_wrong_shape_fails(spark):
    model = embedders.Embedder("short", 3, open_model=lambda: lambda texts: np.zeros((len(texts), 2)))
    df = spark.createDataFrame([("a", "MKV")], "seq_id string, sequence string")
    with pytest.raises(Exception, match="backend 'short' gave an array"):
        embedders.with_vectors(df, "sequence", model).collect()
    with pytest.raises(ValueError, match="already have"):
        embedders.with_vectors(df.withColumn("embedding", F.lit(1)), "sequence", model)


def test_pools_are_bounded(monkeypatch):
    monkeypatch.setattr(embedders, "POOL_LETTERS", 100)
    texts = ["x" * n for n in (30, 30, 50, 500, 1, 99, 100, 0, 101)]
    batches = [pa.record_batch([pa.array(texts[:4])], names=["s"]), pa.record_batch([pa.array(texts[4:])], names=["s"])]
    pools = [p.column(0).to_pylist() for p in embedders.pooled(iter(batches), 0, 4)]
    assert [t for p in pools for t in p] == texts
    assert all(sum(map(len, p)) <= 100 or len(p) == 1 or sum(map(len, p[1:])) == 0 for p in pools)
