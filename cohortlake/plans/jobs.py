"""Composite jobs: the public entry points that chain sources, operators, models and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions.embedders import BATCH, embedder, with_vectors
from cohortlake.functions.sequence import (
    letters_only,
    match_count,
    pattern_positions,
    rejected_letters,
    sanitized,
)
from cohortlake.functions.vector import first_features
from cohortlake.models import feature_classifier as classifier
from cohortlake.models import kernel_svm
from cohortlake.models.linear import Bundle, fit_svm, predict, weighted_rows
from cohortlake.operators import features as feats
from cohortlake.operators import labels as labelling
from cohortlake.operators import metrics as scoring
from cohortlake.operators.kernels import Kernel, cosine, kernel_against
from cohortlake.operators.projection import fit_components
from cohortlake.operators.ranking import sample_per_class
from cohortlake.operators.splits import stratified_fraction, stratified_split
from cohortlake.sinks import writers
from cohortlake.sources import catalog, tabular
from cohortlake.sources.fasta import read_clean_fasta


# --- ingest -----------------------------------------------------------------------------------


def embed(sequences: DataFrame, backend: str | None = "dummy", batch: int = BATCH) -> DataFrame:
    """``(seq_id, length, backend, dim, embedding)`` of ``(seq_id, sequence)`` rows.

    A batched backend gets ``batch`` sequences at a time.
    """
    chosen = embedder(backend)
    return with_vectors(sequences.select("seq_id", "sequence"), "sequence", chosen, batch).select(
        "seq_id",
        F.length("sequence").alias("length"),
        F.lit(chosen.backend).alias("backend"),
        F.lit(chosen.dim).alias("dim"),
        "embedding",
    )


def embed_sequences(
    spark: SparkSession, path: str, backend: str = "dummy", table: str = "embeddings", batch: int = BATCH
) -> int:
    """Read sequences, embed them and append to ``table``; returns the number of rows appended."""
    before = spark.table(table).count() if spark.catalog.tableExists(table) else 0
    writers.append_embeddings(embed(tabular.read_sequences(spark, path), backend, batch), table)
    return spark.table(table).count() - before


def prepare_features(
    table: DataFrame, features: Sequence[str], min_variance: float = 1e-8
) -> tuple[DataFrame, list[str], list[str]]:
    """Impute medians, drop low-variance features, encode labels and assemble the vector.

    Returns the rows plus kept and dropped features. Values pass through single precision.
    """
    if not table.filter(F.col("label").isNull()).isEmpty():
        raise ValueError("some rows have a null label; label or remove them first")
    imputed = feats.impute(table, feats.fit_medians(table, features))
    kept, dropped = feats.select_varying(imputed, features, min_variance)
    if not kept:
        raise ValueError("every feature varies too little to be kept")
    vector = F.array(*[feats.quoted(f).cast("float").cast("double") for f in kept])
    rows = labelling.encode_labels(imputed, "label").select(
        "sample_id", "label", F.col("label_index").cast("int"), vector.alias("features"), "group_id"
    )
    return rows, kept, dropped


def ingest_features(
    spark: SparkSession,
    path: str,
    table: str = "multiomics",
    id_col: str = "patient_id",
    label_col: str = "clinical_status",
    feature_cols: Sequence[str] | None = None,
    min_variance: float = 1e-8,
    overwrite: bool = False,
    group_col: str | None = None,
) -> dict:
    """Ingest a wide feature CSV; returns class counts, kept and dropped features."""
    raw, features = tabular.read_feature_csv(spark, path, id_col, label_col, feature_cols, group_col)
    rows, kept, dropped = prepare_features(raw, features, min_variance)
    writers.write_features(rows, kept, table, overwrite)
    counts = {r["label"]: r["count"] for r in labelling.label_counts(rows, "label").collect()}
    return {"classes": dict(sorted(counts.items())), "features": kept, "dropped": dropped}


def prepare_labelled_sequences(
    spark: SparkSession, fasta: str, mapping: str, outdir: str, per_class: int = 300, train_frac: float = 0.8, seed: int = 1337
) -> DataFrame:
    """Join sequences with their enzyme class, cap and split per class, write FASTA and labels.

    Returns the split rows ``(accession, sequence, ec_top, part)``.
    """
    sequences = read_clean_fasta(spark, fasta).filter(F.length("sequence").between(50, 512))
    labelled = sequences.join(tabular.read_enzyme_map(spark, mapping), "accession")
    capped = sample_per_class(labelled, "ec_top", "accession", per_class, seed)
    split = stratified_fraction(capped, "ec_top", "accession", train_frac, seed)
    for part in ("train", "heldout"):
        rows = split.filter(F.col("part") == part)
        writers.write_fasta(rows, f"{outdir}/{part}.fa")
        writers.write_csv(
            rows.select(F.col("accession").alias("seq_id"), "ec_top", F.length("sequence").alias("length")),
            f"{outdir}/labels_{part}.csv",
        )
    return split


# --- inspection -------------------------------------------------------------------------------


def embedding_stats(embeddings: DataFrame) -> DataFrame:
    """Rows and length range per (backend, dim), most rows first."""
    return (
        embeddings.groupBy("backend", "dim")
        .agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("min_len"), F.max("length").alias("max_len"))
        .orderBy(F.desc("n"), "backend", "dim")
    )


def embedding_summary(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("backend", "dim").agg(
        F.count("seq_id").alias("n"),
        F.min("length").alias("min_len"),
        F.avg("length").alias("mean_len"),
        F.max("length").alias("max_len"),
    )


def preview(embeddings: DataFrame, limit: int = 5) -> DataFrame:
    return embeddings.select("seq_id", "length", "backend", "dim").orderBy("seq_id").limit(limit)


def find_pattern(texts: DataFrame, ident: str, text: str, patterns: Sequence[str]) -> DataFrame:
    """All occurrences, overlapping ones included, as ``(ident, pattern, position)``."""
    return pattern_positions(texts, [ident], text, patterns)


def top_matches(texts: DataFrame, ident: str, text: str, patterns: Sequence[str], k: int = 8) -> DataFrame:
    """The ``k`` (row, pattern) combinations with most occurrences as ``(ident, pattern, n)``."""
    counts = F.array(
        *[F.struct(F.lit(p).alias("pattern"), match_count(F.col(text), p).cast("long").alias("n")) for p in patterns]
    )
    rows = texts.select(ident, F.inline(counts)).filter(F.col("n") > 0)
    return rows.orderBy(F.desc("n"), ident, "pattern").limit(k)


def validate_sequences(sequences: DataFrame, sanitize: bool = False, limit: int = 0) -> DataFrame:
    """``(seq_id, ok, sequence, rejected)``: cleaned text, or a rejection with the offending letters.

    ``limit`` keeps that many records when it is positive: the first in file order for sequences
    that carry ``file_order`` (``read_sequences(..., ordered=True)``), else the first by id.
    """
    if limit > 0:
        order = "file_order" if "file_order" in sequences.columns else "seq_id"
        sequences = sequences.orderBy(order).limit(limit)
    use = sanitized if sanitize else letters_only
    cleaned = sequences.select(
        "seq_id", letters_only(F.col("sequence")).alias("raw"), use(F.col("sequence")).alias("text")
    )
    bad = rejected_letters(F.col("raw"))
    ok = F.lit(True) if sanitize else F.size(bad) == 0
    return cleaned.select("seq_id", ok.alias("ok"), F.when(ok, F.col("text")).alias("sequence"), bad.alias("rejected"))


# --- training ---------------------------------------------------------------------------------


def _labelled(embeddings: DataFrame, labels: DataFrame | None, rule: str) -> DataFrame:
    if labels is None:
        return labelling.rule_label(embeddings, "length", rule)
    labelling.require_labels(embeddings, labels, "seq_id")
    return labelling.attach_labels(embeddings, labels, "seq_id")


def train_linear_svm(
    embeddings: DataFrame,
    labels: DataFrame | None = None,
    rule: str = "median-length",
    feature_cap: int | None = None,
    test_size: float = 0.25,
    seed: int = 42,
    max_iter: int = 100,
) -> tuple[dict, Bundle, DataFrame]:
    """Linear-kernel SVM; returns metrics, the model and the predictions it was judged on.

    With fewer than four rows or one class there is no test part; the training accuracy is
    reported instead. ``labels`` has ``(seq_id, label)`` with one row per id.
    """
    rows = _labelled(embeddings, labels, rule).select(
        "seq_id", "label", first_features(F.col("embedding"), feature_cap).alias("x"), "dim", "backend"
    )
    rows = stratified_split(rows, "label", "seq_id", test_size, seed).persist()
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("part") == "train").alias("train"),
        F.min(F.size("x")).alias("low"),
        F.max(F.size("x")).alias("high"),
        F.first("dim").alias("dim"),
        F.first("backend").alias("backend"),
    ).first()
    if not facts["n"]:
        raise ValueError("there is no embedding to train on")
    if facts["low"] != facts["high"]:
        raise ValueError("vectors of several widths cannot train one model")
    classes = labelling.sorted_labels(rows, "label")
    if len(classes) < 2:
        raise ValueError("training needs rows of two classes or more")
    training = weighted_rows(rows.filter("part = 'train'"), "label", classes, F.col("x"), False)
    model = fit_svm(training, len(classes), facts["high"], 1.0, max_iter)
    has_test = facts["train"] < facts["n"]
    judged = rows.filter(F.col("part") == ("test" if has_test else "train"))
    predictions = predict(model, judged.select("seq_id", "label", "x"), F.col("x"), classes).drop("x")
    accuracy = scoring.accuracy(predictions, "label", "prediction").first()[0]
    metrics = {"classes": classes, "used_features": facts["high"], "n_train": facts["train"]}
    if has_test:
        metrics |= {"test_accuracy": accuracy, "n_test": facts["n"] - facts["train"]}
    else:
        metrics |= {
            "train_accuracy": accuracy,
            "note": f"too few rows to hold any out; the first {facts['high']} of {facts['dim']} entries were used",
        }
    settings = {"labels": classes, "used_features": facts["high"], "backend": facts["backend"]}
    return metrics, Bundle(model, settings), predictions


def train_feature_classifier(
    rows: DataFrame, features: Sequence[str], settings: classifier.Settings = classifier.Settings()
) -> dict:
    """Grouped cross-validation, full refit and all report tables.

    ``rows`` has ``(sample_id, label, group_id, features)``. The result holds DataFrames
    (``predictions``, ``confusion_matrix``, ``classification_report``, ``fold_metrics``,
    ``performance``, ``top_features``), the fold count and the fitted model.
    """
    predictions, folds = classifier.cross_validate(rows, features, settings)
    predictions = predictions.persist()
    fitted = classifier.fit_all(rows, features, settings)
    probabilities = {label: f"proba_{label}" for label in fitted.labels}
    quality = scoring.one_vs_rest_quality(predictions, "label", probabilities)
    weights = fitted.coefficients(predictions.sparkSession)
    return {
        "predictions": predictions,
        "cv_splits": folds,
        "classes": fitted.labels,
        "fitted": fitted,
        "confusion_matrix": scoring.confusion_matrix(predictions, "label", "prediction"),
        "classification_report": scoring.classification_report(predictions, "label", "prediction"),
        "fold_metrics": scoring.summary_scores(
            scoring.class_scores(predictions, "label", "prediction", ["fold"]), ["fold"]
        ).select("fold", "accuracy", "balanced_accuracy", "f1_macro"),
        "performance": scoring.summary_scores(scoring.class_scores(predictions, "label", "prediction")),
        "ranking": quality.agg(
            F.avg("roc_auc").alias("roc_auc_ovr"), F.avg("average_precision").alias("average_precision")
        ),
        "top_features": scoring.top_weights(weights, "label", "feature", "weight"),
    }


def classifier_metrics(result: dict) -> dict:
    """The small result tables of ``train_feature_classifier`` as one document."""

    def rows(name: str) -> list[dict]:
        return [r.asDict() for r in result[name].collect()]

    return {
        "classes": result["classes"],
        "cv_splits": result["cv_splits"],
        **rows("performance")[0],
        **rows("ranking")[0],
        **{name: rows(name) for name in ("confusion_matrix", "classification_report", "fold_metrics", "top_features")},
    }


def train_kernel_svm(
    embeddings: DataFrame, labels: DataFrame, settings: kernel_svm.Settings = kernel_svm.Settings()
) -> kernel_svm.Comparison:
    """Best of several kernel SVMs against an RBF baseline; ``labels`` has ``(seq_id, label)``, one row per id."""
    labelled = _labelled(embeddings, labels, "")
    return kernel_svm.train(labelled, "seq_id", "label", "embedding", settings)


# --- scoring ----------------------------------------------------------------------------------


def score_sequences(
    sequences: DataFrame, bundle: Bundle, backend: str | None = None, batch: int = BATCH
) -> DataFrame:
    """``(seq_id, prediction)`` with a stored linear model.

    A longer vector is cut to the model's width; a shorter one, or another backend than the one
    the model was trained on, is an error.
    """
    chosen = embedder(backend or bundle.settings["backend"])
    width = bundle.settings["used_features"]
    if chosen.dim < width:
        raise ValueError(f"backend '{chosen.backend}' gives {chosen.dim} entries, the model was fitted on {width}")
    if chosen.backend != bundle.settings["backend"]:
        raise ValueError(f"The model was trained on backend '{bundle.settings['backend']}'")
    vectors = embed(sequences, chosen.backend, batch).select("seq_id", "embedding")
    scored = predict(bundle.model, vectors, first_features(F.col("embedding"), width), bundle.settings["labels"])
    return scored.select("seq_id", "prediction")


def score_kernel_model(embeddings: DataFrame, bundle: Bundle) -> DataFrame:
    """``(seq_id, prediction)`` of ``(seq_id, embedding)`` rows with a stored kernel model."""
    components, fitted = kernel_svm.restore(bundle)
    projected = embeddings.select("seq_id", components.column(F.col("embedding")).alias("x"))
    return fitted.predict(projected, "x").select("seq_id", "prediction")


# --- report -----------------------------------------------------------------------------------


def similarity_by_width(
    rows: DataFrame, ident: str, backend: str, vector: str, kernel: Kernel, references_per_backend: int
) -> DataFrame:
    """``(ident, ref_id, k)`` of every row against a seeded sample of its own backend and width.

    Vectors of different widths are never compared. Null vectors are left out.
    """
    sized = rows.select(ident, backend, F.size(vector).alias("__dim"), F.col(vector).alias("__v")).filter("__v is not null")
    kinds = sized.select(backend, "__dim").distinct().collect()
    found = []
    for kind in kinds:
        own = sized.filter(F.col(backend).eqNullSafe(kind[backend]) & (F.col("__dim") == kind["__dim"]))
        sample = sample_per_class(own, backend, ident, references_per_backend, 42)
        found.append(kernel_against(own, sample, ident, "__v", kernel, most=references_per_backend))
    if not found:
        kind = dict(rows.dtypes)[ident]
        return rows.sparkSession.createDataFrame([], f"`{ident}` {kind}, ref_id {kind}, k double")
    return reduce(DataFrame.unionByName, found)


def report_embeddings(
    embeddings: DataFrame, predictions: DataFrame | None = None, references_per_backend: int = 200
) -> dict:
    """Tables of the embeddings report, including the data behind its figures.

    ``landmark_similarity`` holds the cosine of every row with ``references_per_backend`` rows of its
    own backend and width, drawn by hash, so it grows with the rows and not with their square;
    ``landmark_counts`` tells how many were drawn.
    """
    tables = {
        "embeddings_summary": embedding_summary(embeddings),
        "length_histogram": feats.equal_width_histogram(embeddings, "length"),
    }
    vectors = embeddings.select("seq_id", "backend", F.expr("slice(embedding, 1, dim)").alias("v"))
    tables["landmark_similarity"] = similarity_by_width(
        vectors, "seq_id", "backend", "v", cosine, references_per_backend
    )
    counts = vectors.filter("v is not null").groupBy("backend", F.size("v").alias("dim")).count()
    tables["landmark_counts"] = counts.select(
        "backend", "dim", F.least("count", F.lit(references_per_backend)).alias("landmarks")
    )
    if predictions is not None:
        tables["predictions"] = predictions
        if {"seq_id", "prediction"} <= set(predictions.columns):
            joined = embeddings.select("seq_id", "length").join(predictions.select("seq_id", "prediction"), "seq_id")
            judged = labelling.rule_label(joined, "length").withColumn("prediction", F.col("prediction").cast("int"))
            tables["confusion_matrix"] = scoring.confusion_matrix(judged, "label", "prediction", [0, 1])
            tables["accuracy"] = scoring.accuracy(judged, "label", "prediction")
    return tables


def report_features(rows: DataFrame, features: Sequence[str], predictions: DataFrame | None = None) -> dict:
    """Tables of the feature report: class counts, statistics, correlation, 2-D coordinates, metrics."""
    long = feats.named_long(rows, "features", features, ["label"])
    stats = feats.class_feature_stats(long, "label")
    tables = {
        "label_counts": labelling.label_counts(rows, "label"),
        "feature_means": feats.wide_class_table(stats, "label", features, "mean"),
        "feature_stds": feats.wide_class_table(stats, "label", features, "std"),
        "feature_overall_stats": feats.overall_feature_stats(long),
        "feature_correlation": feats.vector_correlation(rows, "features", features),
    }
    if len(features) >= 2:
        components = fit_components(rows, "features", 2)
        point = components.column(F.col("features"))
        tables["explained_variance"] = rows.sparkSession.createDataFrame(
            [(f"pc{i + 1}", v) for i, v in enumerate(components.explained)], "component string, ratio double"
        )
        tables["coordinates"] = rows.select("sample_id", "label", point.alias("p")).select(
            "sample_id", "label", F.col("p")[0].alias("pc1"), F.get("p", F.lit(1)).alias("pc2")
        )
    if predictions is None:
        return tables
    if "label" not in predictions.columns:
        predictions = predictions.join(rows.select("sample_id", "label"), "sample_id", "left")
    if "prediction" in predictions.columns:
        judged = predictions.withColumns(
            {"label": F.col("label").cast("string"), "prediction": F.col("prediction").cast("string")}
        )
        matrix = scoring.confusion_matrix(judged, "label", "prediction")
        labels = labelling.sorted_labels(matrix, "true_label")
        columns = {label: f"proba_{label}" for label in labels}
        available = columns if set(columns.values()) <= set(judged.columns) else None
        tables["performance_metrics"] = scoring.performance_table(judged, "label", "prediction", available)
        tables["confusion_matrix"] = scoring.confusion_wide(matrix, labels)
        tables["classification_report"] = scoring.classification_report(judged, "label", "prediction")
    return tables


def report(
    spark: SparkSession,
    outdir: str,
    predictions_path: str | None = None,
    features_table: str = "multiomics",
    embeddings_table: str = "embeddings",
) -> list[str]:
    """Write one CSV folder per report table; returns their names."""
    predictions = tabular.read_predictions(spark, predictions_path)
    if catalog.report_source(spark, features_table, embeddings_table) == "features":
        rows = catalog.require_rows(catalog.features_table(spark, features_table), features_table)
        tables = report_features(rows, catalog.feature_names(spark, features_table), predictions)
    else:
        rows = catalog.require_rows(catalog.embeddings_table(spark, embeddings_table), embeddings_table)
        tables = report_embeddings(rows, predictions)
    for name, table in tables.items():
        writers.write_csv(table, f"{outdir}/{name}")
    return sorted(tables)
