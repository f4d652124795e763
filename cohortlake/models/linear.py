"""Linear classifiers on vector columns, and the files they are stored in."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVCModel, LogisticRegressionModel, OneVsRestModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions.vector import as_double
from cohortlake.models.dual import Machine, fit_machines
from cohortlake.models.output import LinearModel, index_of_greatest, training_rows
from cohortlake.operators.labels import class_weights, weight_column
from cohortlake.sinks.writers import write_text

__all__ = ["Bundle", "LinearModel", "fit_svm", "in_parallel", "index_of", "label_at", "predict", "training_rows", "weighted_rows"]


def index_of(label: str, labels: Sequence) -> Column:
    pairs = [x for i, value in enumerate(labels) for x in (F.lit(value), F.lit(float(i)))]
    return F.create_map(*pairs)[F.col(label)]


def label_at(index: Column, labels: Sequence) -> Column:
    return F.get(F.array(*[F.lit(v) for v in labels]), index.cast("int"))


def weighted_rows(
    df: DataFrame, label: str, labels: Sequence, vector: Column, balanced: bool, keys: Sequence[str] = ()
) -> DataFrame:
    """``(keys, label, __y, __w, __x)`` ready for an ML estimator."""
    weight: Column = F.lit(1.0)
    if balanced:
        weight = weight_column([(r[label], r["weight"]) for r in class_weights(df, label).collect()], label)
    return df.select(
        *keys,
        label,
        index_of(label, labels).alias("__y"),
        weight.alias("__w"),
        array_to_vector(as_double(vector)).alias("__x"),
    )


def fit_svm(rows: DataFrame, classes: int, width: int, C: float = 1.0, max_iter: int = 100) -> LinearModel:
    """Soft-margin linear SVM with penalty ``C``; one machine per class when there are more than two.

    ``C`` multiplies the summed weighted loss. All machines are fitted together, see ``dual``;
    ``max_iter`` bounds the steps.
    """
    machines = [Machine(1, C=C)] if classes == 2 else [Machine(k, C=C) for k in range(classes)]
    return fit_machines(rows, machines, width, max_steps=max_iter).model()


def in_parallel(task: Callable, items: Sequence, workers: int = 4) -> list:
    """Run independent fits side by side; results keep the order of ``items``."""
    with ThreadPoolExecutor(min(workers, max(1, len(items)))) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(task), items))


def predict(
    model: LinearModel | LinearSVCModel | OneVsRestModel, df: DataFrame, vector: Column, labels: Sequence, out: str = "prediction"
) -> DataFrame:
    if isinstance(model, LinearModel):
        scored = df.withColumn("__o", model.outputs(vector))
        return scored.withColumn("__p", label_at(index_of_greatest(F.col("__o")), labels)).select(*df.columns, F.col("__p").alias(out))
    scored = model.transform(df.withColumn("__x", array_to_vector(as_double(vector))))
    model_out = model.getPredictionCol()
    return scored.withColumn("__p", label_at(F.col(model_out), labels)).select(*df.columns, F.col("__p").alias(out))


@dataclass
class Bundle:
    """A stored model: the fitted classifier, its settings and optional parameter tables."""

    model: LinearModel | LinearSVCModel | OneVsRestModel | LogisticRegressionModel
    settings: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        if isinstance(self.model, LinearModel):
            self.model.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        settings = {**self.settings, "tables": sorted(self.tables), "kind": type(self.model).__name__}
        write_text(spark, json.dumps(settings), f"{path}/settings")
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, required: Sequence[str]) -> Bundle:
        settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
        missing = set(required) - set(settings) - set(settings["tables"])
        if missing:
            raise ValueError(f"the stored model lacks {sorted(missing)}")
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in settings["tables"]}
        if settings["kind"] == LinearModel.__name__:
            return Bundle(LinearModel.of(spark.read.parquet(f"{path}/model")), settings, tables)
        readers = {r.__name__: r for r in (LinearSVCModel, OneVsRestModel, LogisticRegressionModel)}
        return Bundle(readers[settings["kind"]].load(f"{path}/model"), settings, tables)
