"""Command line for the composite jobs."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from cohortlake.functions.embedders import BATCH
from cohortlake.models import feature_classifier, kernel_svm
from cohortlake.models.linear import Bundle
from cohortlake.plans import jobs
from cohortlake.session import get_session
from cohortlake.sinks import writers
from cohortlake.sources import catalog, tabular


def _save_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    writers.write_text(spark, json.dumps(metrics, default=str), path)
    print(json.dumps(metrics, default=str))


def embed(spark: SparkSession, a: argparse.Namespace) -> None:
    print(f"rows={jobs.embed_sequences(spark, a.input, a.backend, a.table, a.batch)}")


def ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    info = jobs.ingest_features(
        spark, a.input, a.table, a.id_col, a.label_col, a.feature_col, a.min_variance, a.overwrite, a.group_col
    )
    print(json.dumps(info))


def query(spark: SparkSession, a: argparse.Namespace) -> None:
    table = catalog.embeddings_table(spark, a.table)
    print(f"rows={table.count()}")
    jobs.preview(table, a.limit).show(truncate=False)
    if a.stats:
        jobs.embedding_stats(table).show(truncate=False)


def _labels(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    return tabular.read_labels_csv(spark, a.labels_csv, a.label_col) if a.labels_csv else None


def train_linear(spark: SparkSession, a: argparse.Namespace) -> None:
    table = catalog.embeddings_table(spark, a.table)
    metrics, bundle, _ = jobs.train_linear_svm(table, _labels(spark, a), a.rule, a.feature_cap)
    bundle.save(spark, a.model_out)
    _save_metrics(spark, metrics, a.out)


def train_features(spark: SparkSession, a: argparse.Namespace) -> None:
    settings = feature_classifier.Settings(
        a.random_state, a.C, a.class_weight == "balanced", a.cv_splits, a.feature_k, a.pseudocount, a.max_iter
    )
    rows = catalog.features_table(spark, a.table)
    result = jobs.train_feature_classifier(rows, catalog.feature_names(spark, a.table), settings)
    writers.write_csv(result["predictions"], a.pred_out)
    result["fitted"].bundle(settings).save(spark, a.model_out)
    _save_metrics(spark, jobs.classifier_metrics(result), a.out)


def train_kernel(spark: SparkSession, a: argparse.Namespace) -> None:
    settings = kernel_svm.Settings(
        pca_components=a.pca_components,
        kernels=a.kernel,
        gamma_factors=a.gamma_factor,
        centrings=[{"yes": True, "no": False}[c] for c in a.centred],
        per_class_limit=a.per_class_limit,
        C=a.C,
        balanced=a.class_weight == "balanced",
        test_size=a.test_size,
        seed=a.random_state,
    )
    found = jobs.train_kernel_svm(catalog.embeddings_table(spark, a.table), _labels(spark, a), settings)
    found.bundle(spark).save(spark, a.model_out)
    writers.write_csv(found.predictions, f"{a.model_out}/predictions")
    _save_metrics(spark, found.metrics, a.out)


def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    bundle = Bundle.load(spark, a.model, ["labels", "used_features", "backend"])
    writers.write_csv(jobs.score_sequences(tabular.read_sequences(spark, a.input), bundle, a.backend, a.batch), a.out)


def predict_kernel(spark: SparkSession, a: argparse.Namespace) -> None:
    bundle = Bundle.load(spark, a.model, kernel_svm.REQUIRED)
    vectors = jobs.embed(tabular.read_sequences(spark, a.input), a.backend, a.batch)
    writers.write_csv(jobs.score_kernel_model(vectors, bundle), a.out)


def find(spark: SparkSession, a: argparse.Namespace) -> None:
    texts = tabular.read_sequences(spark, a.input)
    writers.write_csv(jobs.find_pattern(texts, "seq_id", "sequence", a.pattern), a.out)
    jobs.top_matches(texts, "seq_id", "sequence", a.pattern).show(truncate=False)


def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = jobs.validate_sequences(tabular.read_sequences(spark, a.input, a.limit > 0), a.sanitize, a.limit)
    writers.write_json(rows, a.out)
    rows.groupBy("ok").count().show()


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    print("\n".join(jobs.report(spark, a.tabledir, a.pred, a.features_table, a.embeddings_table)))


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = jobs.prepare_labelled_sequences(spark, a.fasta, a.map, a.outdir, a.per_class, a.train_frac)
    rows.groupBy("part", "ec_top").count().orderBy("part", "ec_top").show()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cohortlake", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, run, *arguments):
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        for flags, options in arguments:
            sub.add_argument(*flags.split(), **options)

    def opt(flags, default=None, kind=str, **more):
        return flags, {"default": default, "type": kind, **more}

    source = ("input", {})
    labels = [opt("--labels-csv"), opt("--label-col", "label")]
    weight = opt("--class-weight", "balanced", choices=["balanced", "none"])
    batch = opt("--batch", BATCH, int)
    command("embed", embed, source, opt("--backend", "dummy"), opt("--table", "embeddings"), batch)
    command(
        "ingest",
        ingest,
        source,
        opt("--table", "multiomics"),
        opt("--id-col", "patient_id"),
        opt("--label-col", "clinical_status"),
        ("--feature-col", {"action": "append"}),
        opt("--min-variance", 1e-8, float),
        ("--overwrite", {"action": "store_true"}),
        opt("--group-col"),
    )
    stats = ("--stats", {"action": argparse.BooleanOptionalAction, "default": True})
    command("query", query, opt("--table", "embeddings"), opt("--limit", 5, int), stats)
    command(
        "train-linear",
        train_linear,
        opt("--table", "embeddings"),
        *labels,
        opt("--rule", "median-length"),
        opt("--feature-cap", None, int),
        opt("--out", "results/metrics/linear"),
        opt("--model-out", "results/models/linear"),
    )
    command(
        "train-features",
        train_features,
        opt("--table", "multiomics"),
        opt("--random-state", 42, int),
        opt("--C", 1.0, float),
        weight,
        opt("--cv-splits", 5, int),
        opt("--feature-k", None, int),
        opt("--pseudocount", 1e-6, float),
        opt("--max-iter", 1000, int),
        opt("--out", "results/metrics/features"),
        opt("--model-out", "results/models/features"),
        opt("--pred-out", "results/predictions_features"),
    )
    command(
        "train-kernel",
        train_kernel,
        opt("--table", "embeddings"),
        ("--labels-csv", {"required": True}),
        opt("--label-col", "ec_top"),
        opt("--pca-components", 12, int),
        opt("--kernel", ["rbf"], nargs="+"),
        opt("--gamma-factor", [1.0], float, nargs="+"),
        opt("--centred", ["yes"], nargs="+"),
        opt("--per-class-limit", 200, int),
        opt("--C", 1.0, float),
        weight,
        opt("--test-size", 0.25, float),
        opt("--random-state", 42, int),
        opt("--out", "results/metrics/kernel"),
        opt("--model-out", "results/models/kernel"),
    )
    command(
        "predict",
        predict,
        source,
        opt("--model", "results/models/linear"),
        opt("--backend"),
        batch,
        opt("--out", "results/predictions"),
    )
    command(
        "predict-kernel",
        predict_kernel,
        source,
        opt("--model", "results/models/kernel"),
        opt("--backend", "dummy"),
        batch,
        opt("--out", "results/predictions_kernel"),
    )
    command("find", find, source, ("pattern", {"nargs": "+"}), opt("--out", "results/matches"))
    command(
        "validate",
        validate,
        source,
        opt("--limit", 0, int),
        ("--sanitize", {"action": "store_true"}),
        opt("--out", "results/validated"),
    )
    command(
        "report",
        report,
        opt("--pred"),
        opt("--tabledir", "results/tables"),
        opt("--features-table", "multiomics"),
        opt("--embeddings-table", "embeddings"),
    )
    command(
        "prepare",
        prepare,
        opt("--fasta", required=True),
        opt("--map", required=True),
        opt("--per-class", 300, int),
        opt("--train-frac", 0.8, float),
        opt("--outdir", "data"),
    )
    return top


def main(arguments: list[str] | None = None) -> None:
    chosen = parser().parse_args(arguments)
    chosen.run(get_session("cohortlake"), chosen)


if __name__ == "__main__":
    main()
