import random

import numpy as np
import pytest

from cohortlake.models.linear import Bundle
from cohortlake.plans import jobs
from cohortlake.sinks import writers
from cohortlake.sources import catalog, tabular

SIX = ">seqA\nMKTIIALSYIF\n>seqB\nGVVDSGTT\n>seqC\nMTSAGAA\n>seqD\nGGGGGGGG\n>seqE\nMNVNSTH\n>seqF\nGGGTTTCC\n"


@pytest.fixture
def clean_catalog(spark):
    yield
    for table in spark.catalog.listTables():
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")


def test_embed_train_score(spark, tmp_path, clean_catalog):
    path = tmp_path / "six.fa"
    path.write_text(SIX)
    assert jobs.embed_sequences(spark, str(path), table="emb") == 6
    assert jobs.embed_sequences(spark, str(path), table="emb2") == 6
    stored = catalog.embeddings_table(spark, "emb")
    stats = jobs.embedding_stats(stored).first()
    assert tuple(stats) == ("dummy", 64, 6, 7, 11)
    assert jobs.embedding_summary(stored).first()["mean_len"] == pytest.approx(49 / 6)
    assert [r["seq_id"] for r in jobs.preview(stored, 2).collect()] == ["seqA", "seqB"]
    labels = tmp_path / "labels.csv"
    labels.write_text("ID,kind\n" + "".join(f"seq{c},{'flare' if c in 'ACE' else 'remission'}\n" for c in "ABCDEF"))
    table = tabular.read_labels_csv(spark, str(labels), "kind")
    metrics, bundle, _ = jobs.train_linear_svm(stored, table, feature_cap=4, max_iter=20)
    assert metrics["classes"] == ["flare", "remission"] and metrics["used_features"] == 4
    assert (metrics["n_train"], metrics["n_test"]) == (4, 2) and 0 <= metrics["test_accuracy"] <= 1
    bundle.save(spark, str(tmp_path / "m"))
    loaded = Bundle.load(spark, str(tmp_path / "m"), ["labels", "used_features", "backend"])
    scored = jobs.score_sequences(tabular.read_sequences(spark, str(path)), loaded)
    assert scored.columns == ["seq_id", "prediction"] and scored.count() == 6
    writers.write_csv(scored, str(tmp_path / "preds"))
    names = jobs.report(spark, str(tmp_path / "report"), None, "no_features", "emb")
    assert names == ["embeddings_summary", "landmark_counts", "landmark_similarity", "length_histogram"]
    similarity = spark.read.csv(str(tmp_path / "report" / "landmark_similarity"), header=True, inferSchema=True)
    assert similarity.count() == 36
    with pytest.raises(ValueError, match="the model was fitted on"):
        loaded.settings["used_features"] = 99
        jobs.score_sequences(tabular.read_sequences(spark, str(path)), loaded)


def test_too_few_rows_train_on_all(spark):
    rows = spark.createDataFrame([("s1", "MKTIIALSYIF"), ("s2", "GVVDSGTT")], "seq_id string, sequence string")
    metrics, _, predictions = jobs.train_linear_svm(jobs.embed(rows), feature_cap=4, max_iter=20)
    assert metrics["classes"] == [0, 1] and metrics["n_train"] == 2 and "first 4 of 64" in metrics["note"]
    assert metrics["train_accuracy"] == 1.0 and predictions.count() == 2


def test_report_with_heuristic_predictions(spark):
    rows = spark.createDataFrame([("a", "M" * 5), ("b", "M" * 9), ("c", "M" * 12)], "seq_id string, sequence string")
    predictions = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("zz", 1)], "seq_id string, prediction int")
    tables = jobs.report_embeddings(jobs.embed(rows), predictions)
    assert tables["accuracy"].first()[0] == pytest.approx(2 / 3)
    cells = {(r["true_label"], r["pred_label"]): r["count"] for r in tables["confusion_matrix"].collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 1}


def test_older_vector_column(spark, clean_catalog):
    spark.sql("create table old using parquet as select 'foo1' seq_id, 10 length, 'dummy' backend, 3 dim, array(0f, 1f, 2f) vec")
    row = catalog.embeddings_table(spark, "old").first()
    assert (row["seq_id"], row["embedding"]) == ("foo1", [0.0, 1.0, 2.0])
    with pytest.raises(ValueError, match="neither"):
        catalog.report_source(spark, "x1", "x2")
    assert catalog.report_source(spark, "x1", "old") == "embeddings"


def test_ingest_train_report(spark, tmp_path, clean_catalog):
    rng = np.random.default_rng(1)
    lines = ["patient_id,clinical_status,visit,mgx_a,mgx_b,fiber,flat"]
    for i in range(60):
        sick = i % 2
        values = [f"{v:.4f}" for v in (np.exp(sick + rng.normal()), np.exp(rng.normal()), 10 - 3 * sick + rng.normal())]
        if i == 7:
            values[2] = "n/a"
        lines.append(f"p{i},{'flare' if sick else 'remission'},{i // 4},{','.join(values)},1.0")
    path = tmp_path / "omics.csv"
    path.write_text("\n".join(lines) + "\n")
    columns = ["mgx_a", "mgx_b", "fiber", "flat"]
    info = jobs.ingest_features(spark, str(path), "omics", feature_cols=columns, group_col="visit")
    assert info == {"classes": {"flare": 30, "remission": 30}, "features": columns[:3], "dropped": ["flat"]}
    with pytest.raises(ValueError, match="Feature order differs"):
        jobs.ingest_features(spark, str(path), "omics", feature_cols=["fiber", "mgx_a"])
    jobs.ingest_features(spark, str(path), "omics", feature_cols=columns, group_col="visit", overwrite=True)
    rows = catalog.features_table(spark, "omics")
    assert rows.count() == 60 and rows.select("group_id").distinct().count() == 15
    names = catalog.feature_names(spark, "omics")
    result = jobs.train_feature_classifier(rows, names, jobs.classifier.Settings(max_iter=30, cv_splits=3))
    assert result["classes"] == ["flare", "remission"] and result["cv_splits"] == 3
    writers.write_csv(result["predictions"], str(tmp_path / "preds"))
    written = jobs.report(spark, str(tmp_path / "report"), str(tmp_path / "preds"), "omics")
    assert {"label_counts", "feature_means", "feature_stds", "feature_overall_stats", "performance_metrics", "confusion_matrix", "classification_report", "coordinates", "feature_correlation"} <= set(written)
    tidy = spark.read.csv(str(tmp_path / "report" / "performance_metrics"), header=True).collect()
    assert {"f1_macro", "roc_auc", "average_precision"} <= {r["metric"] for r in tidy}
    slim = spark.read.csv(str(tmp_path / "preds"), header=True).select("sample_id", "prediction")
    tables = jobs.report_features(rows, names, slim)
    assert tables["confusion_matrix"].count() == 2 and tables["performance_metrics"].count() == 7


def test_prepare_labelled_sequences(spark, tmp_path):
    rng = random.Random(4)
    fasta, mapping = [], ["Entry\tEC number"]
    for i in range(120):
        length = rng.choice([20, 60, 200, 600])
        fasta.append(f">sp|P{i}|N{i} x\n" + "".join(rng.choice("ACDEFGH") for _ in range(length)) + "\n")
        mapping.append(f"P{i}\t{i % 8}.1.1.1; 2.2.2.2")
    (tmp_path / "in.fa").write_text("".join(fasta))
    (tmp_path / "map.tsv").write_text("\n".join(mapping) + "\n")
    out = tmp_path / "out"
    split = jobs.prepare_labelled_sequences(spark, str(tmp_path / "in.fa"), str(tmp_path / "map.tsv"), str(out), per_class=5).collect()
    assert {r["ec_top"] for r in split} <= set(range(1, 7)) and all(50 <= len(r["sequence"]) <= 512 for r in split)
    sizes = {}
    for r in split:
        sizes.setdefault(r["ec_top"], []).append(r["part"])
    assert all(len(p) <= 5 and p.count("train") == max(1, round(len(p) * 0.8)) for p in sizes.values())
    for part in ("train", "heldout"):
        back = {tuple(r) for r in tabular.read_sequences(spark, str(out / f"{part}.fa")).collect()}
        assert back == {(r["accession"], r["sequence"]) for r in split if r["part"] == part}
        labels = spark.read.csv(str(out / f"labels_{part}.csv"), header=True)
        assert labels.columns == ["seq_id", "ec_top", "length"] and labels.count() == len(back)
