import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlake.functions import vector as vec
from cohortlake.operators import kernels


def points(spark, n, width, seed, offset=0):
    x = np.random.default_rng(seed).normal(size=(n, width))
    df = spark.createDataFrame([(i + offset, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    return x, df.repartition(3)


def as_matrix(df, rows, cols):
    cells = {(r["id"], r["ref_id"]): r["k"] for r in df.collect()}
    assert len(cells) == len(rows) * len(cols)
    return np.array([[cells[i, j] for j in cols] for i in rows])


def expected_cosine(x, y):
    unit = [m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9) for m in (x, y)]
    return unit[0] @ unit[1].T


@pytest.mark.parametrize(
    "kernel, expected",
    [
        (kernels.linear, lambda x, y: x @ y.T),
        (kernels.cosine, expected_cosine),
        (kernels.fidelity, lambda x, y: expected_cosine(x, y) ** 2),
        (kernels.angles(0.7), lambda x, y: np.cos(0.7 * (x[:, None] - y[None])).mean(-1)),
        (kernels.rbf(0.3), lambda x, y: np.exp(-0.3 * ((x[:, None] - y[None]) ** 2).sum(-1))),
    ],
)
def test_kernel_against(spark, kernel, expected):
    x, rows = points(spark, 40, 3, 1)
    y, refs = points(spark, 11, 3, 2, offset=1000)
    got = as_matrix(kernels.kernel_against(rows, refs, "id", "v", kernel), range(40), range(1000, 1011))
    assert np.allclose(got, expected(x, y))


def test_angle_columns(spark):
    x, rows = points(spark, 6, 4, 5)
    re, im = kernels.angle_columns(F.col("v"), 2.0)
    got = rows.select("id", re.alias("re"), im.alias("im")).orderBy("id").collect()
    assert np.allclose([r["re"] for r in got], np.cos(2 * x)) and np.allclose([r["im"] for r in got], np.sin(2 * x))


def test_centring(spark):
    x, refs = points(spark, 12, 3, 6)
    z, rows = points(spark, 20, 3, 7)
    square = kernels.kernel_against(refs, refs, "id", "v", kernels.linear)
    k = x @ x.T
    one = np.full((12, 12), 1 / 12)
    got = as_matrix(kernels.centre_training(square, "id", "ref_id"), range(12), range(12))
    assert np.allclose(got, k - one @ k - k @ one + one @ k @ one) and np.allclose(got.sum(1), 0)
    kt = z @ x.T
    test = kernels.kernel_against(rows, refs, "id", "v", kernels.linear, centred=True)
    assert "Exchange hash" not in test._jdf.queryExecution().executedPlan().toString()
    got = as_matrix(test, range(20), range(12))
    assert np.allclose(got, kt - kt.mean(1, keepdims=True) - k.mean(0) + k.mean())


def test_landmark_features_reproduce_the_centred_kernel(spark):
    x, rows = points(spark, 25, 3, 8)
    kernel = kernels.angles(0.8)
    fitted = kernels.KernelFeatures.fit(x, kernel, centred=True)
    phi = rows.select("id", kernels.kernel_features_column(rows, F.col("v"), fitted, kernel).alias("p")).orderBy("id")
    phi = np.array([r["p"] for r in phi.collect()])
    k = kernel(x, x)
    assert np.allclose(phi @ phi.T, k - k.mean(0) - k.mean(1, keepdims=True) + k.mean(), atol=1e-8)


def test_reference_set(spark):
    x, refs = points(spark, 5, 2, 9)
    found = kernels.reference_set(refs, "id", "v")
    assert found.ids == list(range(5)) and np.allclose(found.matrix, x)
    with pytest.raises(ValueError, match="more than 4"):
        kernels.reference_set(refs, "id", "v", most=4)
    with pytest.raises(ValueError, match="empty"):
        kernels.reference_set(refs.filter("id < 0"), "id", "v")


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(
        vec.l2_normalized(F.col("a")).alias("unit"),
        vec.scaled(F.col("a"), 0.5).alias("s"),
        vec.first_features(F.col("a"), 1).alias("cut"),
        vec.first_features(F.col("a"), 0).alias("whole"),
    ).collect()
    assert rows[0]["unit"] == pytest.approx([0.6, 0.8]) and rows[1]["unit"] == [0.0, 0.0]
    assert rows[0]["s"] == [1.5, 2.0]
    assert rows[0]["cut"] == [3.0] and rows[0]["whole"] == [3.0, 4.0]


def test_matrix_checks():
    assert vec.matrix_of(pa.array([], pa.list_(pa.float64()))).shape == (0, 0)
    assert vec.matrix_of(pa.array([[1.0, 2.0], [3.0, 4.0]])).tolist() == [[1.0, 2.0], [3.0, 4.0]]
    assert vec.matrix_of(pa.array([[0.0], [1.0], [2.0]]).slice(1)).tolist() == [[1.0], [2.0]]
    with pytest.raises(ValueError, match="different widths"):
        vec.matrix_of(pa.array([[1.0, 0.0, 3.0], [2.0]]))
    with pytest.raises(ValueError, match="null"):
        vec.matrix_of(pa.array([[1.0, 2.0], None]))
