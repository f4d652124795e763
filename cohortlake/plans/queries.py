"""Registered queries: every operator applied to the driver tables, each next to its SQL check.

``QUERIES`` maps a name to ``(spark, folder) -> DataFrame``; ``ORACLE`` maps it to DuckDB SQL over the
same tables. Queries without SQL depend on iterative fits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import embedders
from cohortlake.functions import sequence as seq
from cohortlake.functions import vector as vec
from cohortlake.models import dual, feature_classifier, kernel_svm
from cohortlake.models.linear import label_at, weighted_rows
from cohortlake.operators import features as feats
from cohortlake.operators import kernels, labels, metrics, splits
from cohortlake.operators.curves import ranking_quality
from cohortlake.operators.neighbours import neighbour_information
from cohortlake.operators.projection import fit_components
from cohortlake.operators.quantiles import exact_quantiles
from cohortlake.operators.ranking import sample_per_class
from cohortlake.plans import jobs
from cohortlake.session import checkpoint
from cohortlake.sources.tabular import with_synthetic_ids

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(value: Column) -> Column:
    return F.round(value, 6)


# --- shared frames --------------------------------------------------------------------------

LETTERS_SQL = "[" + ", ".join(f"'{c}'" for c in seq.RESIDUES) + "]"
COMPOSITION_SQL = f"""
counted AS (
  SELECT doc_id, lang, source, list_transform({LETTERS_SQL}, lambda c: length(text) - length(replace(text, c, ''))) AS c
  FROM documents),
composition AS (
  SELECT doc_id, lang, source, list_transform(range(0, 64), lambda i:
    CASE WHEN n = 0 THEN 0.0 ELSE CAST(CAST(c[(i % 20) + 1] / n AS FLOAT) AS DOUBLE) END) AS v
  FROM (SELECT *, sqrt(CAST(list_sum(list_transform(c, lambda x: x * x)) AS DOUBLE)) AS n FROM counted))
"""
LETTER_SHARES_SQL = f"""
{COMPOSITION_SQL},
shares AS (
  SELECT doc_id, lang AS label, {LETTERS_SQL}[CAST(p AS INTEGER)] AS feature, v[CAST(p AS INTEGER)] AS value
  FROM composition, range(1, 21) AS r(p))
"""


def composition_vectors(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", "lang", "source", seq.composition(F.col("text")).alias("v"))


def letter_shares(spark: SparkSession, folder: str) -> DataFrame:
    """``(label, feature, value)``: the first twenty composition entries in long form."""
    vectors = composition_vectors(spark, folder).select(F.col("lang").alias("label"), F.slice("v", 1, 20).alias("v"))
    return feats.named_long(vectors, "v", list(seq.RESIDUES), ["label"])


WIDE = ["f_qty", "f_price", "f_disc", "f_tax", "f_const", "f_void"]
MEASURED = WIDE[:4]
WIDE_SQL = """
wide AS (
  SELECT l_orderkey, l_linenumber, l_returnflag AS label, l_suppkey,
    CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity END AS f_qty,
    l_extendedprice AS f_price, l_discount AS f_disc, l_tax AS f_tax,
    CAST(5 AS DOUBLE) AS f_const, CAST(NULL AS DOUBLE) AS f_void
  FROM lineitem)
"""


def wide(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_returnflag").alias("label"),
        "l_suppkey",
        F.when(F.col("l_discount") != 0, F.col("l_quantity")).alias("f_qty"),
        F.col("l_extendedprice").alias("f_price"),
        F.col("l_discount").alias("f_disc"),
        F.col("l_tax").alias("f_tax"),
        F.lit(5.0).alias("f_const"),
        F.lit(None).cast("double").alias("f_void"),
    )


def long_sql(features: list[str], keys: str = "") -> str:
    head = f"{keys}, " if keys else ""
    return " UNION ALL ".join(f"SELECT {head}'{f}' AS feature, {f} AS value FROM wide" for f in features)


# Deterministic language scores: the share of one marker letter per language.
MARKERS = {"de": "z", "en": "w", "es": "a", "fr": "u"}
PROBA = {lang: f"proba_{lang}" for lang in MARKERS}
SCORED_SQL = """
marks AS (
  SELECT doc_id, lang AS label, source,
    length(text) - length(replace(text, 'z', '')) + 1 AS n_de,
    length(text) - length(replace(text, 'w', '')) + 1 AS n_en,
    length(text) - length(replace(text, 'a', '')) + 1 AS n_es,
    length(text) - length(replace(text, 'u', '')) + 1 AS n_fr
  FROM documents),
scored AS (
  SELECT doc_id, label, source,
    n_de / (n_de + n_en + n_es + n_fr) AS proba_de, n_en / (n_de + n_en + n_es + n_fr) AS proba_en,
    n_es / (n_de + n_en + n_es + n_fr) AS proba_es, n_fr / (n_de + n_en + n_es + n_fr) AS proba_fr,
    CASE WHEN n_de >= greatest(n_en, n_es, n_fr) THEN 'de' WHEN n_en >= greatest(n_es, n_fr) THEN 'en'
         WHEN n_es >= n_fr THEN 'es' ELSE 'fr' END AS prediction
  FROM marks)
"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    size = F.octet_length("text")
    n = {k: F.col(f"n_{k}") for k in MARKERS}
    marks = docs.select(
        "doc_id",
        F.col("lang").alias("label"),
        "source",
        *[(size - F.octet_length(F.replace("text", F.lit(c), F.lit(""))) + 1).alias(f"n_{k}") for k, c in MARKERS.items()],
    )
    total = n["de"] + n["en"] + n["es"] + n["fr"]
    best = (
        F.when(n["de"] >= F.greatest(n["en"], n["es"], n["fr"]), "de")
        .when(n["en"] >= F.greatest(n["es"], n["fr"]), "en")
        .when(n["es"] >= n["fr"], "es")
        .otherwise("fr")
    )
    return marks.select(
        "doc_id", "label", "source", *[(n[k] / total).alias(PROBA[k]) for k in MARKERS], best.alias("prediction")
    )


CLASS_SCORES_SQL = """
every AS (SELECT label AS c FROM scored UNION SELECT prediction FROM scored),
per_class AS (
  SELECT c AS label, sum(CAST(s.label = c AND s.prediction = c AS BIGINT)) AS hits,
    sum(CAST(s.label = c AS BIGINT)) AS support, sum(CAST(s.prediction = c AS BIGINT)) AS predicted
  FROM every, scored s GROUP BY c),
scores AS (
  SELECT label, coalesce(hits / nullif(predicted, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r,
    coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f, support, hits
  FROM per_class)
"""
METRICS_SQL = f"WITH {SCORED_SQL}, {CLASS_SCORES_SQL}"

EMBED_SQL = """
embedded AS (
  SELECT CAST(doc_id AS VARCHAR) AS seq_id, CAST(length(text) AS INTEGER) AS length, 'dummy' AS backend, 64 AS dim FROM documents)
"""


def embedded(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return jobs.embed(docs.select(F.col("doc_id").cast("string").alias("seq_id"), F.col("text").alias("sequence")))


# --- scans and projections ------------------------------------------------------------------


@query("scan_embeddings", "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings")
def _(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", "label", F.size("embedding").alias("dim"))


@query(
    "scan_features",
    """SELECT l_orderkey, l_linenumber, l_returnflag AS label, l_quantity AS f0, l_extendedprice AS f1, l_tax AS f2
    FROM lineitem""",
)
def _(spark, folder):
    items = table(spark, folder, "lineitem")
    rows = items.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_returnflag").alias("label"),
        F.array("l_quantity", "l_extendedprice", "l_tax").alias("features"),
    )
    return rows.select("l_orderkey", "l_linenumber", "label", *[F.col("features")[i].alias(f"f{i}") for i in range(3)])


@query("seq_length", "SELECT doc_id, CAST(length(text) AS INTEGER) AS length FROM documents")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.length("text").alias("length"))


@query(
    "synthetic_ids", "SELECT 'seq_' || row_number() OVER (ORDER BY doc_id) AS seq_id, doc_id FROM documents"
)
def _(spark, folder):
    return with_synthetic_ids(table(spark, folder, "documents")).select("seq_id", "doc_id")


@query(
    "feature_cap",
    """SELECT vec_id, CAST(i - 1 AS INTEGER) AS position, round(CAST(embedding[i] AS DOUBLE), 6) AS value
    FROM (SELECT vec_id, embedding, unnest(range(1, 9)) AS i FROM embeddings)""",
)
def _(spark, folder):
    capped = table(spark, folder, "embeddings").select("vec_id", vec.first_features(F.col("embedding"), 8).alias("v"))
    return feats.vector_to_long(capped, "v", ["vec_id"]).withColumn("value", r6(F.col("value")))


@query(
    "accession_extract",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'P' || p_partkey WHEN 1 THEN 'Q' || p_partkey
      ELSE 'R' || p_partkey END AS accession FROM part""",
)
def _(spark, folder):
    part = table(spark, folder, "part")
    key, name = F.col("p_partkey"), F.col("p_name")
    header = (
        F.when(key % 3 == 0, F.concat(F.lit(">sp|P"), key, F.lit("|"), name))
        .when(key % 3 == 1, F.concat(F.lit("tr|Q"), key, F.lit("|"), name))
        .otherwise(F.concat(F.lit(" R"), key, F.lit(" "), name))
    )
    return part.select("p_partkey", seq.accession(header).alias("accession"))


@query(
    "ec_top_class",
    """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size % 9 AS INTEGER) END AS ec_top FROM part""",
)
def _(spark, folder):
    part = table(spark, folder, "part")
    field = F.when(F.col("p_size") % 5 == 0, F.lit("n/a; 1.1.1.1")).otherwise(
        F.concat(F.lit(" "), F.col("p_size") % 9, F.lit(".4.1.-; 1.1.1.1"))
    )
    return part.select("p_partkey", seq.top_enzyme_class(field).alias("ec_top"))


@query(
    "length_class_filter",
    """SELECT doc_id, CAST(n_chars % 9 AS INTEGER) AS ec_top, CAST(length(text) AS INTEGER) AS length FROM documents
    WHERE length(text) BETWEEN 50 AND 512 AND n_chars % 9 BETWEEN 1 AND 6""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents")
    rows = docs.select(
        "doc_id",
        seq.top_enzyme_class(F.concat(F.col("n_chars") % 9, F.lit(".2.1.3"))).alias("ec_top"),
        F.length("text").alias("length"),
    )
    return rows.filter(F.col("ec_top").between(1, 6) & F.col("length").between(50, 512))


CLEAN_SQL = "cleaned AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS raw FROM documents)"


@query(
    "seq_sanitize",
    f"""WITH {CLEAN_SQL}
    SELECT doc_id, md5(regexp_replace(raw, '[^ACDEFGHIKLMNPQRSTVWYXBZJ]', 'X', 'g')) AS cleaned,
      array_to_string(list_sort(list_distinct(regexp_extract_all(raw, '[^ACDEFGHIKLMNPQRSTVWYXBZJ]'))), '') AS rejected
    FROM cleaned""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("seq_id"), F.col("text").alias("sequence")
    )
    rows = jobs.validate_sequences(docs, sanitize=True)
    return rows.select(
        F.col("seq_id").alias("doc_id"), F.md5("sequence").alias("cleaned"), F.array_join("rejected", "").alias("rejected")
    )


@query(
    "seq_reject",
    f"""WITH {CLEAN_SQL}
    SELECT doc_id, NOT regexp_matches(raw, '[^ACDEFGHIKLMNPQRSTVWYXBZJ]') AS ok FROM cleaned""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("seq_id"), F.col("text").alias("sequence")
    )
    return jobs.validate_sequences(docs).select(F.col("seq_id").alias("doc_id"), "ok")


RAW_NUMBER_SQL = """CASE WHEN l_returnflag = 'A' THEN 'n/a' WHEN l_tax = 0 THEN 'inf' WHEN l_discount = 0 THEN '-inf'
  ELSE CAST(l_quantity AS VARCHAR) END"""


@query(
    "coerce_numeric",
    f"""SELECT l_orderkey, l_linenumber,
      CASE WHEN isinf(x) OR isnan(x) THEN NULL ELSE x END AS value
    FROM (SELECT l_orderkey, l_linenumber, TRY_CAST({RAW_NUMBER_SQL} AS DOUBLE) AS x FROM lineitem)""",
)
def _(spark, folder):
    items = table(spark, folder, "lineitem")
    raw = (
        F.when(F.col("l_returnflag") == "A", "n/a")
        .when(F.col("l_tax") == 0, "inf")
        .when(F.col("l_discount") == 0, "-inf")
        .otherwise(F.col("l_quantity").cast("string"))
    )
    return items.select("l_orderkey", "l_linenumber", feats.coerced(raw).alias("value"))


@query("preview_topn", f"WITH {EMBED_SQL} SELECT * FROM embedded ORDER BY seq_id LIMIT 5")
def _(spark, folder):
    return jobs.preview(embedded(spark, folder), 5)


@query(
    "composition_embed",
    f"""WITH {COMPOSITION_SQL}
    SELECT doc_id, CAST(i AS INTEGER) AS position, round(v[CAST(i AS INTEGER) + 1], 6) AS value
    FROM composition, range(0, 64) AS r(i)""",
)
def _(spark, folder):
    rows = feats.vector_to_long(composition_vectors(spark, folder), "v", ["doc_id"])
    return rows.withColumn("value", r6(F.col("value")))


@query(
    "l2_normalize",
    """SELECT vec_id, CAST(i AS INTEGER) AS position,
      round(e[CAST(i AS INTEGER) + 1] / (sqrt(list_dot_product(e, e)) + 1e-9), 6) AS value
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), range(0, 64) AS r(i)""",
)
def _(spark, folder):
    unit = table(spark, folder, "embeddings").select("vec_id", vec.l2_normalized(F.col("embedding")).alias("v"))
    return feats.vector_to_long(unit, "v", ["vec_id"]).withColumn("value", r6(F.col("value")))


def open_residue_model() -> embedders.Model:
    """A model of its own task: unit vectors of the counts of the twenty residues."""
    wanted = list(seq.RESIDUES.encode())

    def residues(texts: list[str]) -> np.ndarray:
        counts = seq.byte_counts(pa.array(texts, pa.large_string()))[:, wanted].astype(float)
        return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-300)

    return residues


@query(
    "batched_embed",
    f"""WITH {COMPOSITION_SQL}
    SELECT doc_id, CAST(i AS INTEGER) AS position, round(v[CAST(i AS INTEGER) + 1], 6) AS value
    FROM composition, range(0, 20) AS r(i)""",
)
def _(spark, folder):
    model = embedders.Embedder("residues", 20, open_model=open_residue_model)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = feats.vector_to_long(embedders.with_vectors(docs, "text", model, 64), "embedding", ["doc_id"])
    return rows.withColumn("value", r6(F.col("value")))


PATTERNS = ["anan", "the", "ation"]
POSITIONS_SQL = """
chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(0, length(text))) AS position FROM documents),
grams AS (SELECT doc_id, position, c || lead(c, 1, '') OVER w || lead(c, 2, '') OVER w || lead(c, 3, '') OVER w
    || lead(c, 4, '') OVER w AS g FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY position)),
hits AS (SELECT doc_id, p AS pattern, position FROM grams JOIN (VALUES ('anan'), ('the'), ('ation')) AS v(p)
  ON starts_with(g, p))
"""


@query(
    "substring_positions",
    f"WITH {POSITIONS_SQL} SELECT doc_id, pattern, CAST(position AS INTEGER) AS position FROM hits",
)
def _(spark, folder):
    return jobs.find_pattern(table(spark, folder, "documents"), "doc_id", "text", PATTERNS)


@query(
    "match_topk",
    f"""WITH {POSITIONS_SQL} SELECT doc_id, pattern, count(*) AS n FROM hits GROUP BY doc_id, pattern
    ORDER BY n DESC, doc_id, pattern LIMIT 8""",
)
def _(spark, folder):
    return jobs.top_matches(table(spark, folder, "documents"), "doc_id", "text", PATTERNS, 8)


# --- joins ----------------------------------------------------------------------------------

LABEL_ROWS_SQL = """
label_rows AS (
  SELECT doc_id, quality AS label, 0 AS pos FROM labels UNION ALL SELECT doc_id, 2, 1 FROM labels WHERE toxic = 1)
"""


def label_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Labels in which toxic documents appear twice; the later row is the one that counts."""
    raw = table(spark, folder, "labels")
    first = raw.select("doc_id", F.col("quality").alias("label"), F.lit(0).alias("at"))
    again = raw.filter("toxic = 1").select("doc_id", F.lit(2).alias("label"), F.lit(1).alias("at"))
    return first.unionByName(again)


@query(
    "label_join",
    f"""WITH {LABEL_ROWS_SQL}
    SELECT d.doc_id, d.n_chars, l.label FROM documents d
    LEFT JOIN (SELECT doc_id, arg_max(label, pos) AS label FROM label_rows GROUP BY doc_id) l USING (doc_id)""",
)
def _(spark, folder):
    once = labels.last_per_id(label_rows(spark, folder), "doc_id", "label", "at")
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return labels.attach_labels(docs, once, "doc_id")


@query("missing_labels", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, folder):
    return labels.unlabelled(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")


@query(
    "ec_join",
    f"""WITH {CLEAN_SQL}
    SELECT 'P' || doc_id AS accession, CAST(p_size % 9 AS INTEGER) AS ec_top, CAST(length(raw) AS INTEGER) AS length
    FROM cleaned JOIN part ON doc_id = p_partkey WHERE p_size % 9 BETWEEN 1 AND 6 AND length(raw) BETWEEN 50 AND 512""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents")
    sequences = docs.select(
        F.concat(F.lit("P"), "doc_id").alias("accession"), F.length(seq.letters_only(F.col("text"))).alias("length")
    ).filter(F.col("length").between(50, 512))
    field = F.concat(F.col("p_size") % 9, F.lit(".1.1.1"))
    mapping = (
        table(spark, folder, "part")
        .select(F.concat(F.lit("P"), "p_partkey").alias("accession"), seq.top_enzyme_class(field).alias("ec_top"))
        .filter(F.col("ec_top").between(1, 6))
    )
    return sequences.join(mapping, "accession").select("accession", "ec_top", "length")


@query(
    "pred_join",
    """SELECT d.doc_id, d.n_chars AS length, l.quality AS prediction,
      CAST(d.n_chars > (SELECT median(n_chars) FROM documents JOIN labels USING (doc_id)) AS INTEGER) AS label
    FROM documents d JOIN labels l USING (doc_id)""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("n_chars").alias("length"))
    predictions = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("prediction"))
    return labels.rule_label(docs.join(predictions, "doc_id"), "length")


@query(
    "pred_label_left",
    """SELECT l.doc_id, l.quality AS prediction, d.lang AS label FROM labels l
    LEFT JOIN (SELECT * FROM documents WHERE n_chars > 500) d USING (doc_id)""",
)
def _(spark, folder):
    predictions = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("prediction"))
    known = table(spark, folder, "documents").filter("n_chars > 500").select("doc_id", F.col("lang").alias("label"))
    return labels.attach_labels(predictions, known, "doc_id")


# --- counts and statistics ------------------------------------------------------------------


@query("row_count", "SELECT count(*) AS rows FROM documents")
def _(spark, folder):
    return embedded(spark, folder).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "embedding_stats",
    f"""WITH {EMBED_SQL} SELECT backend, dim, count(*) AS n, min(length) AS min_len, max(length) AS max_len
    FROM embedded GROUP BY backend, dim ORDER BY n DESC""",
)
def _(spark, folder):
    return jobs.embedding_stats(embedded(spark, folder))


@query(
    "embedding_summary",
    f"""WITH {EMBED_SQL} SELECT backend, dim, count(seq_id) AS n, min(length) AS min_len,
      round(avg(length), 6) AS mean_len, max(length) AS max_len FROM embedded GROUP BY backend, dim""",
)
def _(spark, folder):
    return jobs.embedding_summary(embedded(spark, folder)).withColumn("mean_len", r6(F.col("mean_len")))


@query("label_counts", 'SELECT l_returnflag AS label, count(*) AS "count" FROM lineitem GROUP BY 1')
def _(spark, folder):
    return labels.label_counts(wide(spark, folder), "label")


@query(
    "feature_means",
    f"""WITH {WIDE_SQL}, long AS ({long_sql(MEASURED, "label")})
    SELECT label, feature, round(avg(value), 6) AS mean FROM long GROUP BY label, feature""",
)
def _(spark, folder):
    stats = feats.class_feature_stats(feats.to_long(wide(spark, folder), MEASURED, ["label"]), "label")
    return stats.select("label", "feature", r6(F.col("mean")).alias("mean"))


@query(
    "feature_stds",
    f"""WITH {WIDE_SQL}, long AS ({long_sql(MEASURED, "label")})
    SELECT label, feature, round(stddev_pop(value), 6) AS std FROM long GROUP BY label, feature""",
)
def _(spark, folder):
    stats = feats.class_feature_stats(feats.to_long(wide(spark, folder), MEASURED, ["label"]), "label")
    return stats.select("label", "feature", r6(F.col("std")).alias("std"))


@query(
    "feature_overall_stats",
    f"""WITH {WIDE_SQL}, long AS ({long_sql(MEASURED)})
    SELECT feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
      max(value) AS max FROM long GROUP BY feature""",
)
def _(spark, folder):
    stats = feats.overall_feature_stats(feats.to_long(wide(spark, folder), MEASURED))
    return stats.select("feature", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "min", "max")


@query(
    "feature_correlation",
    f"""WITH {WIDE_SQL.replace("CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity END", "l_quantity")}
    SELECT a AS feature_a, b AS feature_b, round(r, 6) AS corr FROM (
    {" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM wide" for a in MEASURED for b in MEASURED)})""",
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("f_qty"),
        F.col("l_extendedprice").alias("f_price"),
        F.col("l_discount").alias("f_disc"),
        F.col("l_tax").alias("f_tax"),
    )
    return feats.feature_correlation(rows, MEASURED).withColumn("corr", r6(F.col("corr")))


@query(
    "length_histogram",
    """WITH s AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi, least(30, greatest(5, floor(sqrt(count(*))))) AS b
      FROM documents),
    placed AS (SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / b)), b - 1) AS INTEGER) AS bin FROM documents, s)
    SELECT CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / b), 6) AS left_edge,
      (SELECT count(*) FROM placed WHERE placed.bin = i) AS count
    FROM s, range(0, 30) AS r(i) WHERE i < b""",
)
def _(spark, folder):
    histogram = feats.equal_width_histogram(table(spark, folder, "documents"), "n_chars")
    return histogram.withColumn("left_edge", r6(F.col("left_edge")))


# --- imputation, selection, scaling ---------------------------------------------------------


@query(
    "median_impute",
    f"""WITH {WIDE_SQL} SELECT l_orderkey, l_linenumber,
      {", ".join(f"coalesce({f}, (SELECT median({f}) FROM wide)) AS {f}" for f in WIDE)} FROM wide""",
)
def _(spark, folder):
    rows = wide(spark, folder)
    return feats.impute(rows, feats.fit_medians(rows, WIDE)).select("l_orderkey", "l_linenumber", *WIDE)


@query(
    "variance_filter",
    f"""WITH {WIDE_SQL}, long AS ({long_sql(WIDE)})
    SELECT feature, round(var_samp(value), 6) AS variance, coalesce(var_samp(value) > 1e-8, false) AS kept
    FROM long GROUP BY feature""",
)
def _(spark, folder):
    table_ = feats.feature_variances(wide(spark, folder), WIDE, 1e-8)
    return table_.withColumn("variance", r6(F.col("variance")))


@query(
    "median_length_label",
    """SELECT doc_id, CAST(n_chars > (SELECT median(n_chars) FROM documents) AS INTEGER) AS label FROM documents""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return labels.rule_label(docs, "n_chars").select("doc_id", "label")


@query(
    "robust_angle_scale",
    f"""WITH {WIDE_SQL}, long AS ({long_sql(MEASURED)}), q AS (
      SELECT feature, quantile_cont(abs(value), 0.9) AS p90 FROM long WHERE value IS NOT NULL GROUP BY feature)
    SELECT feature, round(p90, 6) AS p90, round(CASE WHEN p90 < 1e-12 THEN pi() / 4 ELSE pi() / 4 / p90 END, 9) AS multiplier
    FROM q""",
)
def _(spark, folder):
    scale = feats.robust_angle_scale(wide(spark, folder), MEASURED, math.pi / 4)
    return scale.select("feature", r6(F.col("p90")).alias("p90"), F.round("multiplier", 9).alias("multiplier"))


LOG_RATIO_SQL = """
WITH logs AS (
  SELECT l_orderkey, l_linenumber, ln(l_quantity + 1e-6) AS a, ln(l_tax + 1e-6) AS b, ln(l_discount + 1e-6) AS c,
    l_extendedprice AS other FROM lineitem)
SELECT l_orderkey, l_linenumber, round(a - (a + b + c) / 3, 6) AS mgx_a, round(b - (a + b + c) / 3, 6) AS mgx_b,
  round(c - (a + b + c) / 3, 6) AS mtx_c, other FROM logs
"""


@query("clr_transform", LOG_RATIO_SQL)
def _(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("mgx_a"),
        F.col("l_tax").alias("mgx_b"),
        F.col("l_discount").alias("mtx_c"),
        F.col("l_extendedprice").alias("other"),
    )
    chosen = feats.compositional(rows.columns)
    return feats.centred_log_ratio(rows, chosen).withColumns({f: r6(F.col(f)) for f in chosen})


SCALED = ["f_price", "f_disc", "f_tax", "f_const"]


@query(
    "standardize",
    f"""WITH {WIDE_SQL}, m AS (SELECT
      {", ".join(f"avg({f}) AS m_{f}, coalesce(nullif(stddev_pop({f}), 0), 1) AS s_{f}" for f in SCALED)} FROM wide)
    SELECT l_orderkey, l_linenumber, {", ".join(f"round(({f} - m_{f}) / s_{f}, 6) AS {f}" for f in SCALED)}
    FROM wide, m""",
)
def _(spark, folder):
    rows = wide(spark, folder).select("l_orderkey", "l_linenumber", *SCALED)
    return feats.standardize(rows, SCALED).withColumns({f: r6(F.col(f)) for f in SCALED})


@query(
    "feature_order_check",
    """SELECT count(DISTINCT names) AS orders, min(w) AS min_width, max(w) AS max_width,
      count(DISTINCT names) = 1 AND min(w) = max(w) AS consistent
    FROM (SELECT 'e' || (len(embedding) % 2) || ',' || 'e' || (label % 2) AS names, CAST(len(embedding) AS INTEGER) AS w FROM embeddings)""",
)
def _(spark, folder):
    rows = table(spark, folder, "embeddings")
    names = F.array(
        F.concat(F.lit("e"), F.size("embedding") % 2), F.concat(F.lit("e"), F.col("label") % 2)
    )
    return feats.layout_check(rows.withColumn("names", names), "names", "embedding")


MUTUAL_SQL = f"""
WITH {LETTER_SHARES_SQL},
edges AS (SELECT feature, quantile_cont(value, [{", ".join(str(i / 10) for i in range(1, 10))}]) AS e FROM shares GROUP BY feature),
binned AS (SELECT s.feature, s.label, len(list_filter(e, lambda q: s.value > q)) AS bin FROM shares s JOIN edges USING (feature)),
cells AS (SELECT feature, bin, label, CAST(count(*) AS DOUBLE) AS c FROM binned GROUP BY ALL),
parts AS (SELECT feature, c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bin) AS nb,
  sum(c) OVER (PARTITION BY feature, label) AS nl FROM cells),
mi AS (SELECT feature, round(sum(c / n * ln(c * n / (nb * nl))), 12) AS m FROM parts GROUP BY feature)
SELECT feature, round(m, 6) AS mutual_information, CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS rank
FROM mi QUALIFY rank <= 10
"""


@query(
    "mutual_info_neighbours",
    f"""WITH {LETTER_SHARES_SQL},
    p AS (SELECT feature, label, round(value * 1000000) AS v, row_number() OVER () AS id, count(*) OVER (PARTITION BY feature, label) AS size
      FROM shares WHERE value IS NOT NULL AND label IS NOT NULL QUALIFY size > 1),
    pairs AS (SELECT a.feature, a.id, a.v, a.size, list_sort(list(abs(a.v - b.v))) AS away
      FROM p a JOIN p b ON a.feature = b.feature AND a.label = b.label AND a.id <> b.id GROUP BY a.feature, a.id, a.v, a.size),
    near AS (SELECT feature, id, v, size, least(3, size - 1) AS need, away[least(3, size - 1)] AS r FROM pairs),
    within AS (SELECT n.feature, n.id, n.size, n.need,
        count(*) FILTER (WHERE CASE WHEN r > 0 THEN q.v > n.v - r AND q.v < n.v + r ELSE q.v = n.v END) AS m
      FROM near n JOIN p q ON q.feature = n.feature GROUP BY n.feature, n.id, n.size, n.need),
    psi AS (SELECT i AS x, -0.5772156649015329 + sum(CASE WHEN i > 1 THEN 1.0 / (i - 1) ELSE 0 END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS y
      FROM (SELECT unnest(range(1, 1 + (SELECT count(*) FROM p))) AS i)),
    mi AS (SELECT w.feature, count(*) AS n, any_value(total.y) + avg(a.y - b.y - c.y) AS m
      FROM (SELECT *, count(*) OVER (PARTITION BY feature) AS every FROM within) w JOIN psi a ON a.x = need JOIN psi b ON b.x = size
        JOIN psi c ON c.x = w.m JOIN psi total ON total.x = every GROUP BY w.feature)
    SELECT feature, n, round(greatest(m, 0), 6) AS mutual_information FROM mi""",
)
def _(spark, folder):
    """Shares in millionths are whole numbers, so equal distances are exactly equal."""
    rows = letter_shares(spark, folder).withColumn("value", F.round(F.col("value") * 1_000_000))
    scores = neighbour_information(rows, "label")
    return scores.select("feature", "n", r6(F.col("mutual_information")).alias("mutual_information"))


@query("mutual_info_topk", MUTUAL_SQL)
def _(spark, folder):
    scores = feats.mutual_information_long(letter_shares(spark, folder), "label")
    return scores.filter("rank <= 10").withColumn("mutual_information", r6(F.col("mutual_information")))


@query(
    "masked_mean_pool",
    f"""WITH counted AS (
      SELECT conv_id, list_transform({LETTERS_SQL}, lambda c: length(text) - length(replace(text, c, ''))) AS c
      FROM conversations WHERE role <> 'system'),
    v AS (SELECT conv_id, list_transform(c, lambda x: CASE WHEN n = 0 THEN 0.0 ELSE CAST(CAST(x / n AS FLOAT) AS DOUBLE) END) AS v
      FROM (SELECT *, sqrt(CAST(list_sum(list_transform(c, lambda x: x * x)) AS DOUBLE)) AS n FROM counted))
    SELECT conv_id, CAST(i AS INTEGER) AS position, round(avg(v[CAST(i % 20 AS INTEGER) + 1]), 6) AS value
    FROM v, range(0, 64) AS r(i) GROUP BY conv_id, i""",
)
def _(spark, folder):
    turns = table(spark, folder, "conversations").select(
        "conv_id", "role", seq.composition(F.col("text")).alias("token")
    )
    pooled = feats.mean_pool(turns, "conv_id", "token", F.col("role") != "system", "v")
    return feats.vector_to_long(pooled, "v", ["conv_id"]).withColumn("value", r6(F.col("value")))


# --- labels, ranking and splits -------------------------------------------------------------


@query(
    "label_index",
    """SELECT doc_id, lang, CAST(i AS INTEGER) AS label_index FROM documents
    JOIN (SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS i FROM (SELECT DISTINCT lang FROM documents)) USING (lang)""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return labels.encode_labels(docs, "lang")


@query(
    "class_weights",
    """SELECT lang, count(*) AS n,
      round((SELECT count(*) FROM documents) / ((SELECT count(DISTINCT lang) FROM documents) * count(*)), 6) AS weight
    FROM documents GROUP BY lang""",
)
def _(spark, folder):
    return labels.class_weights(table(spark, folder, "documents"), "lang").withColumn("weight", r6(F.col("weight")))


@query(
    "per_class_sample",
    """SELECT doc_id, lang FROM documents
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id)) <= 40""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return sample_per_class(docs, "lang", "doc_id", 40, 42)


@query(
    "stratified_split",
    """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
    t AS (SELECT *, sum(n) OVER () AS total, sum(n) OVER () - ceil(sum(n) OVER () * 0.25) AS train FROM c),
    b AS (SELECT *, floor(n * train / total) AS base, n * train / total - floor(n * train / total) AS rest FROM t),
    q AS (SELECT lang, base + CAST(row_number() OVER (ORDER BY rest DESC, lang) <= train - sum(base) OVER () AS INTEGER) AS quota FROM b)
    SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id)) <= quota
      THEN 'train' ELSE 'test' END AS part FROM documents JOIN q USING (lang)""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return splits.stratified_split(docs, "lang", "doc_id", 0.25, 42)


@query(
    "stratified_split_fraction",
    """SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('1337:' || doc_id))
      <= greatest(1, round_even(count(*) OVER (PARTITION BY lang) * 0.8, 0)) THEN 'train' ELSE 'heldout' END AS part
    FROM documents""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return splits.stratified_fraction(docs, "lang", "doc_id", 0.8, 1337)


@query(
    "cv_split_count",
    """SELECT min(n) AS min_class, count(*) AS classes, (SELECT count(DISTINCT source) FROM documents) AS groups,
      least(5, greatest(2, least(min(n), (SELECT count(DISTINCT source) FROM documents)))) AS folds
    FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""",
)
def _(spark, folder):
    return splits.fold_count(table(spark, folder, "documents"), "lang", "source", 5)


def group_fold_sql(rows: str, label: str, group: str, folds: int) -> str:
    return f"""
    gc AS (SELECT {group} AS g, {label} AS c, count(*) AS n FROM {rows} GROUP BY 1, 2),
    gp AS (SELECT g, sum(n) OVER (PARTITION BY g) AS size, c AS main FROM gc
      QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, c) = 1),
    folds AS (SELECT g, CAST((row_number() OVER (PARTITION BY main ORDER BY size DESC, md5('42:' || g)) - 1) % {folds} AS INTEGER)
      AS fold FROM gp)"""


@query(
    "stratified_group_kfold",
    f"WITH {group_fold_sql('lineitem', 'l_returnflag', 'l_orderkey', 5)} SELECT g AS l_orderkey, fold FROM folds",
)
def _(spark, folder):
    return splits.group_folds(table(spark, folder, "lineitem"), "l_returnflag", "l_orderkey", 5)


@query("balanced_group_folds")
def _(spark, folder):
    return splits.balanced_group_folds(table(spark, folder, "lineitem"), "l_returnflag", "l_orderkey", 5)


# --- kernels --------------------------------------------------------------------------------

# All rows are compared with this many landmarks of each label, the library's default.
LANDMARKS_PER_LABEL = kernel_svm.Settings().landmarks_per_class
LANDMARKS_SQL = f"""
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
refs AS (SELECT vec_id AS ref_id, x AS y FROM e
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id)) <= {LANDMARKS_PER_LABEL})
"""


def landmarks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "embeddings")
    return rows.select("vec_id", "embedding"), sample_per_class(rows, "label", "vec_id", LANDMARKS_PER_LABEL, 42)


def kernel_rows(spark: SparkSession, folder: str, kernel: kernels.Kernel) -> DataFrame:
    rows, refs = landmarks(spark, folder)
    return kernels.kernel_against(rows, refs, "vec_id", "embedding", kernel).withColumn("k", r6(F.col("k")))


@query(
    "linear_kernel",
    f"WITH {LANDMARKS_SQL} SELECT vec_id, ref_id, round(list_dot_product(x, y), 6) AS k FROM e, refs",
)
def _(spark, folder):
    return kernel_rows(spark, folder, kernels.linear)


@query(
    "cosine_pairs",
    f"""WITH {LANDMARKS_SQL} SELECT vec_id, ref_id, round(list_dot_product(x, y) /
      ((sqrt(list_dot_product(x, x)) + 1e-9) * (sqrt(list_dot_product(y, y)) + 1e-9)), 6) AS k FROM e, refs""",
)
def _(spark, folder):
    return kernel_rows(spark, folder, kernels.cosine)


@query(
    "rbf_kernel",
    f"""WITH {LANDMARKS_SQL}, g AS (SELECT 1 / (64 * var_pop(u)) AS gamma FROM (SELECT unnest(x) AS u FROM e))
    SELECT vec_id, ref_id, round(exp(-gamma * power(list_distance(x, y), 2)), 6) AS k FROM e, refs, g""",
)
def _(spark, folder):
    gamma = kernels.scale_gamma(feats.vector_moments(table(spark, folder, "embeddings"), "embedding"))
    return kernel_rows(spark, folder, kernels.rbf(gamma))


@query(
    "kernel_center",
    f"""WITH {LANDMARKS_SQL}, k AS (SELECT vec_id, ref_id, list_dot_product(x, y) AS k FROM e, refs),
    tr AS (SELECT * FROM k WHERE vec_id IN (SELECT ref_id FROM refs)),
    cm AS (SELECT ref_id, avg(k) AS m FROM tr GROUP BY ref_id)
    SELECT vec_id, ref_id, round(k - avg(k) OVER (PARTITION BY vec_id) - m + (SELECT avg(k) FROM tr), 6) AS k
    FROM k JOIN cm USING (ref_id)""",
)
def _(spark, folder):
    rows, refs = landmarks(spark, folder)
    found = kernels.kernel_against(rows, refs, "vec_id", "embedding", kernels.linear)
    return kernels.centre_against(found, refs, "vec_id").withColumn("k", r6(F.col("k")))


@query(
    "kernel_center_test",
    f"""WITH {LANDMARKS_SQL}, tr AS (SELECT b.ref_id, list_dot_product(a.y, b.y) AS k FROM refs a, refs b),
    cm AS (SELECT ref_id, avg(k) AS m FROM tr GROUP BY ref_id),
    te AS (SELECT vec_id, ref_id, list_dot_product(x, y) AS k FROM e, refs)
    SELECT vec_id, ref_id, round(k - avg(k) OVER (PARTITION BY vec_id) - m + (SELECT avg(k) FROM tr), 6) AS k
    FROM te JOIN cm USING (ref_id)""",
)
def _(spark, folder):
    rows, refs = landmarks(spark, folder)
    found = kernels.kernel_against(rows, refs, "vec_id", "embedding", kernels.linear, centred=True)
    return found.withColumn("k", r6(F.col("k")))


ANGLE_SCALE = 3.0


@query(
    "phase_feature_map",
    f"""SELECT vec_id, CAST(i - 1 AS INTEGER) AS position, round(cos({ANGLE_SCALE} * x), 6) AS re, round(sin({ANGLE_SCALE} * x), 6) AS im
    FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)""",
)
def _(spark, folder):
    re, im = kernels.angle_columns(F.col("embedding"), ANGLE_SCALE)
    points = table(spark, folder, "embeddings").select("vec_id", re.alias("re"), im.alias("im"))
    rows = points.select("vec_id", F.posexplode(F.arrays_zip("re", "im")).alias("position", "s"))
    return rows.select("vec_id", "position", r6(F.col("s.re")).alias("re"), r6(F.col("s.im")).alias("im"))


@query(
    "fidelity_kernel",
    f"""WITH {LANDMARKS_SQL} SELECT vec_id, ref_id, round(power(list_dot_product(x, y) /
      ((sqrt(list_dot_product(x, x)) + 1e-9) * (sqrt(list_dot_product(y, y)) + 1e-9)), 2), 6) AS k FROM e, refs""",
)
def _(spark, folder):
    return kernel_rows(spark, folder, kernels.fidelity)


@query(
    "angle_kernel",
    f"""WITH {LANDMARKS_SQL} SELECT vec_id, ref_id,
      round(list_avg(list_transform(list_zip(x, y), lambda p: cos({ANGLE_SCALE} * (p[1] - p[2])))), 6) AS k FROM e, refs""",
)
def _(spark, folder):
    return kernel_rows(spark, folder, kernels.angles(ANGLE_SCALE))


@query(
    "mixed_width_kernel",
    """WITH e AS (SELECT vec_id, label, len(embedding) AS dim, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    refs AS (SELECT vec_id AS ref_id, label, dim, x AS y FROM e
      QUALIFY row_number() OVER (PARTITION BY label, dim ORDER BY md5('42:' || vec_id)) <= 200)
    SELECT vec_id, ref_id, round(list_dot_product(x, y), 6) AS k FROM e JOIN refs USING (label, dim)""",
)
def _(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    found = jobs.similarity_by_width(rows, "vec_id", "label", "v", kernels.linear, 200)
    return found.select("vec_id", "ref_id", r6(F.col("k")).alias("k"))


# --- metrics --------------------------------------------------------------------------------


@query(
    "confusion_matrix",
    f"""{METRICS_SQL} SELECT a.c AS true_label, b.c AS pred_label,
      (SELECT count(*) FROM scored WHERE label = a.c AND prediction = b.c) AS count FROM every a, every b""",
)
def _(spark, folder):
    return metrics.confusion_matrix(scored(spark, folder), "label", "prediction")


@query(
    "class_prf",
    f"""{METRICS_SQL} SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
      CAST(support AS BIGINT) AS support FROM scores""",
)
def _(spark, folder):
    scores = metrics.class_scores(scored(spark, folder), "label", "prediction")
    return scores.select("label", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


SUMMARY = [f"{m}_{a}" for a in ("macro", "weighted") for m in ("precision", "recall", "f1")]
SUMMARY_SQL = {
    **{f"{m}_macro": f"avg({m[0]})" for m in ("precision", "recall", "f1")},
    **{f"{m}_weighted": f"sum({m[0]} * support) / sum(support)" for m in ("precision", "recall", "f1")},
}


@query(
    "macro_weighted_prf",
    f"{METRICS_SQL} SELECT {', '.join(f'round({SUMMARY_SQL[c]}, 6) AS {c}' for c in SUMMARY)} FROM scores",
)
def _(spark, folder):
    total = metrics.summary_scores(metrics.class_scores(scored(spark, folder), "label", "prediction"))
    return total.select(*[r6(F.col(c)).alias(c) for c in SUMMARY])


@query("accuracy", f"WITH {SCORED_SQL} SELECT round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy FROM scored")
def _(spark, folder):
    return metrics.accuracy(scored(spark, folder), "label", "prediction").select(r6(F.col("accuracy")).alias("accuracy"))


@query("balanced_accuracy", f"{METRICS_SQL} SELECT round(avg(r), 6) AS balanced_accuracy FROM scores WHERE support > 0")
def _(spark, folder):
    total = metrics.summary_scores(metrics.class_scores(scored(spark, folder), "label", "prediction"))
    return total.select(r6(F.col("balanced_accuracy")).alias("balanced_accuracy"))


@query(
    "classification_report",
    f"""{METRICS_SQL}, rows AS (
      SELECT label, p AS precision, r AS recall, f AS f1, support FROM scores
      UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM scores
      UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM scores
      UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
        sum(f * support) / sum(support), sum(support) FROM scores)
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
      CAST(support AS BIGINT) AS support FROM rows""",
)
def _(spark, folder):
    report = metrics.classification_report(scored(spark, folder), "label", "prediction")
    return report.select("label", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


AUC_SQL = """
ranked AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2 AS rk FROM cases),
auc AS (SELECT c, (sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS roc_auc FROM ranked GROUP BY c),
steps AS (SELECT c, s, sum(y) AS p, count(*) AS n FROM cases GROUP BY c, s),
run AS (SELECT c, p, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY c) AS tp FROM steps
  WINDOW w AS (PARTITION BY c ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT c, sum(p / tp * (cp / cn)) AS average_precision FROM run GROUP BY c)
"""
BINARY_CASES_SQL = "cases AS (SELECT 1 AS c, n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id))"
OVR_CASES_SQL = "cases AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS c, proba_{k} AS s, CAST(label = '{k}' AS INTEGER) AS y FROM scored" for k in MARKERS
) + ")"


@query("roc_auc_binary", f"WITH {BINARY_CASES_SQL}, {AUC_SQL} SELECT round(roc_auc, 6) AS roc_auc FROM auc")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    rows = docs.join(table(spark, folder, "labels"), "doc_id")
    return ranking_quality(rows, "n_chars", "quality").select(r6(F.col("roc_auc")).alias("roc_auc"))


@query(
    "roc_auc_ovr",
    f"""WITH {SCORED_SQL}, {OVR_CASES_SQL}, {AUC_SQL} SELECT c AS label, round(roc_auc, 6) AS roc_auc FROM auc
    UNION ALL SELECT 'macro avg', round(avg(roc_auc), 6) FROM auc""",
)
def _(spark, folder):
    quality = metrics.one_vs_rest_quality(scored(spark, folder), "label", PROBA)
    macro = quality.agg(F.avg("roc_auc").alias("roc_auc")).select(F.lit("macro avg").alias("label"), "roc_auc")
    return quality.select("label", "roc_auc").unionByName(macro).withColumn("roc_auc", r6(F.col("roc_auc")))


@query(
    "average_precision",
    f"""WITH {SCORED_SQL}, {OVR_CASES_SQL}, {AUC_SQL}
    SELECT c AS label, round(average_precision, 6) AS average_precision FROM ap""",
)
def _(spark, folder):
    quality = metrics.one_vs_rest_quality(scored(spark, folder), "label", PROBA)
    return quality.select("label", r6(F.col("average_precision")).alias("average_precision"))


@query(
    "performance_metrics",
    f"""{METRICS_SQL}, {OVR_CASES_SQL}, {AUC_SQL}
    SELECT 'accuracy' AS metric, round(sum(hits) / sum(support), 6) AS value FROM scores
    {" ".join(f"UNION ALL SELECT '{c}', round({SUMMARY_SQL[c]}, 6) FROM scores" for c in SUMMARY)}
    UNION ALL SELECT 'roc_auc', round(avg(roc_auc), 6) FROM auc""",
)
def _(spark, folder):
    return metrics.performance_table(scored(spark, folder), "label", "prediction", PROBA).withColumn(
        "value", r6(F.col("value"))
    )


@query(
    "fold_metrics",
    f"""WITH {SCORED_SQL}, {group_fold_sql("scored", "label", "source", 5)},
    f AS (SELECT fold, label, prediction FROM scored JOIN folds ON source = g),
    every AS (SELECT fold, label AS c FROM f UNION SELECT fold, prediction FROM f),
    s AS (SELECT e.fold, c, sum(CAST(f.label = c AND prediction = c AS BIGINT)) AS hits,
        sum(CAST(f.label = c AS BIGINT)) AS support, sum(CAST(prediction = c AS BIGINT)) AS predicted
      FROM every e JOIN f ON e.fold = f.fold GROUP BY e.fold, c)
    SELECT fold, round(sum(hits) / sum(support), 6) AS accuracy,
      round(avg(CASE WHEN support > 0 THEN hits / support END), 6) AS balanced_accuracy,
      round(avg(2 * hits / (support + predicted)), 6) AS f1_macro FROM s GROUP BY fold""",
)
def _(spark, folder):
    rows = splits.with_group_fold(scored(spark, folder), "label", "source", 5)
    scores = metrics.class_scores(rows, "label", "prediction", ["fold"])
    total = metrics.summary_scores(scores, ["fold"])
    return total.select("fold", *[r6(F.col(c)).alias(c) for c in ("accuracy", "balanced_accuracy", "f1_macro")])


@query(
    "top_features",
    f"""WITH {LETTER_SHARES_SQL},
    w AS (SELECT label, feature, round(avg(value), 6) AS weight FROM shares GROUP BY label, feature)
    SELECT label, feature, weight, CAST(row_number() OVER (PARTITION BY label ORDER BY weight DESC, feature) AS INTEGER) AS rank
    FROM w QUALIFY rank <= 10""",
)
def _(spark, folder):
    shares = letter_shares(spark, folder)
    weights = shares.groupBy("label", "feature").agg(r6(F.avg("value")).alias("weight"))
    return metrics.top_weights(weights, "label", "feature", "weight")


# --- fitted models --------------------------------------------------------

LETTER_NAMES = [f"share_{c}" for c in seq.RESIDUES]


def labelled_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = composition_vectors(spark, folder)
    return rows.select(
        F.col("doc_id").cast("string").alias("sample_id"),
        F.col("lang").alias("label"),
        F.col("source").alias("group_id"),
        F.slice("v", 1, 20).cast("array<double>").alias("features"),
    )


@query("omics_cv_predictions")
def _(spark, folder):
    settings = feature_classifier.Settings()
    predictions, _ = feature_classifier.cross_validate(labelled_features(spark, folder), LETTER_NAMES, settings)
    return predictions


@query("omics_model_coefficients")
def _(spark, folder):
    settings = feature_classifier.Settings(feature_k=12)
    fitted = feature_classifier.fit_all(labelled_features(spark, folder), LETTER_NAMES, settings)
    return fitted.coefficients(spark)


@query(
    "omics_cv_checks",
    f"""WITH rows AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, lang, source FROM documents),
    {group_fold_sql("rows", "lang", "source", 5)},
    names AS (SELECT lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_index FROM (SELECT DISTINCT lang FROM rows))
    SELECT sample_id, fold, label_index, lang AS label, 1.0 AS total, true AS is_most_likely
    FROM rows JOIN folds ON source = g JOIN names USING (lang)""",
)
def _(spark, folder):
    predictions, _ = feature_classifier.cross_validate(labelled_features(spark, folder), LETTER_NAMES)
    chances = [F.col(c) for c in predictions.columns if c.startswith("proba_")]
    own = F.get(F.array(*chances), F.col("prediction_index"))
    return predictions.select(
        "sample_id",
        "fold",
        "label_index",
        "label",
        r6(sum(chances, F.lit(0.0))).alias("total"),
        (own == F.greatest(*chances)).alias("is_most_likely"),
    )


@query(
    "logistic_gradient",
    f"""SELECT label, feature, 0.0 AS gradient FROM (SELECT DISTINCT lang AS label FROM documents),
      (SELECT unnest([{", ".join(f"'{n}'" for n in [*LETTER_NAMES, "intercept"])}]) AS feature)""",
)
def _(spark, folder):
    settings = feature_classifier.Settings()
    rows = feature_classifier.prepared(labelled_features(spark, folder), LETTER_NAMES, settings)
    fitted = feature_classifier.fit_all(labelled_features(spark, folder), LETTER_NAMES, settings)
    gradient = feature_classifier.objective_gradient(fitted, rows, settings)
    return gradient.select("label", "feature", F.round(F.abs("gradient"), 3).alias("gradient"))


@query(
    "cv_fold_gradients",
    f"""SELECT CAST(fold AS INTEGER) AS fold, label, feature, 0.0 AS gradient FROM range(5) f(fold), (SELECT DISTINCT lang AS label FROM documents),
      (SELECT unnest([{", ".join(f"'{n}'" for n in [*LETTER_NAMES, "intercept"])}]) AS feature)""",
)
def _(spark, folder):
    """At its optimum the gradient of a fold's objective over the other folds is zero in every entry."""
    settings = feature_classifier.Settings()
    rows, fitted = feature_classifier.cross_fit(labelled_features(spark, folder), LETTER_NAMES, settings)
    parts = [
        feature_classifier.objective_gradient(model, rows.filter(F.col("fold") != fold), settings).select(
            F.lit(fold).alias("fold"), "label", "feature", F.round(F.abs("gradient"), 4).alias("gradient")
        )
        for fold, model in enumerate(fitted)
    ]
    return reduce(DataFrame.unionByName, parts)


def svm_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, list]:
    """Embeddings as balanced training rows of one machine per label, and the labels."""
    rows = table(spark, folder, "embeddings")
    classes = labels.sorted_labels(rows, "label")
    made = weighted_rows(rows, "label", classes, F.col("embedding"), True, ["vec_id"])
    return checkpoint(dual.keyed(made, F.col("vec_id"))), classes


@query(
    "svm_certificate",
    """SELECT l.label, (SELECT count(*) FROM embeddings) AS n, 0 AS outside, 0.0 AS gap
    FROM (SELECT DISTINCT label FROM embeddings) l""",
)
def _(spark, folder):
    """The objective of the weights against the bound of the duals: no gap means that both are optimal."""
    rows, classes = svm_rows(spark, folder)
    machines = [dual.Machine(k) for k in range(len(classes))]
    fit = dual.fit_machines(rows, machines, 64)
    found = dual.certificate(rows, fit.row_duals(rows), fit)
    gap = (F.col("primal") - F.col("dual")) / F.col("primal")
    return found.select(label_at(F.col("machine"), classes).alias("label"), "n", "outside", F.round(F.abs(gap), 2).alias("gap"))


@query(
    "svm_dual_bounds",
    """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT vec_id, m.label AS machine, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * c.n), 6) AS bound, true AS inside
    FROM embeddings e JOIN c USING (label), (SELECT DISTINCT label FROM embeddings) m""",
)
def _(spark, folder):
    rows, classes = svm_rows(spark, folder)
    fit = dual.fit_machines(rows, [dual.Machine(k) for k in range(len(classes))], 64)
    duals = fit.row_duals(rows).join(rows.select(F.col("__key").alias("key"), "vec_id", "__w"), "key")
    return duals.select(
        "vec_id",
        label_at(F.col("machine"), classes).alias("machine"),
        r6(F.col("__w")).alias("bound"),
        ((F.col("alpha") >= 0) & (F.col("alpha") <= F.col("__w"))).alias("inside"),
    )


@query("linear_svm_predictions")
def _(spark, folder):
    _, _, predictions = jobs.train_linear_svm(embedded(spark, folder), feature_cap=32)
    return predictions


@query("pca_project")
def _(spark, folder):
    rows = table(spark, folder, "embeddings")
    components = fit_components(rows, "embedding", 2)
    return rows.select("vec_id", components.column(F.col("embedding")).alias("p")).select(
        "vec_id", F.col("p")[0].alias("pc1"), F.col("p")[1].alias("pc2")
    )


@query(
    "pca_lengths",
    """WITH cells AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    fit AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM cells GROUP BY i)
    SELECT vec_id, round(sum(power((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 2)), 4) AS length2
    FROM cells JOIN fit USING (i) GROUP BY vec_id""",
)
def _(spark, folder):
    rows = table(spark, folder, "embeddings")
    components = fit_components(rows, "embedding", 64)
    point = rows.select("vec_id", components.column(F.col("embedding")).alias("p"))
    return point.select("vec_id", F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x * x), 4).alias("length2"))


@query(
    "pca_covariance",
    """SELECT CAST(i AS INTEGER) AS component, CAST(j AS INTEGER) AS other, 0.0 AS covariance,
      CASE WHEN i = j THEN 1.0 END AS variance_ratio, i = 0 OR i < j OR i = j AS falling
    FROM range(12) a(i), range(12) b(j) WHERE i <= j""",
)
def _(spark, folder):
    """Components are uncorrelated, and their variances fall and are the explained shares of the total."""
    rows = table(spark, folder, "embeddings")
    components = fit_components(rows, "embedding", 12)
    point = rows.select(components.column(F.col("embedding")).alias("p"))
    a, b = F.posexplode("p").alias("i", "x"), F.posexplode("p").alias("j", "y")
    pairs = point.select("p", a).select("i", "x", b).filter("i <= j")
    found = pairs.groupBy("i", "j").agg(F.covar_samp("x", "y").alias("c"))
    shares = F.array(*[F.lit(float(v)) for v in components.explained])
    # Standardised entries have variance 1 with divisor n, so the sample total is width * n / (n - 1).
    total = rows.agg(64 * F.count(F.lit(1)) / (F.count(F.lit(1)) - 1)).scalar()
    before = F.get(shares, F.col("i") - 1)
    return found.select(
        F.col("i").alias("component"),
        F.col("j").alias("other"),
        F.round(F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.abs("c")), 6).alias("covariance"),
        F.when(F.col("i") == F.col("j"), F.round(F.col("c") / (F.get(shares, "i") * total), 6)).alias("variance_ratio"),
        (F.coalesce(before >= F.get(shares, "i"), F.lit(True))).alias("falling"),
    )


@query(
    "landmark_features",
    f"""WITH {LANDMARKS_SQL}, g AS (SELECT 1 / (64 * var_pop(u)) AS gamma FROM (SELECT unnest(x) AS u FROM e))
    SELECT vec_id, ref_id, round(exp(-gamma * power(list_distance(x, y), 2)), 5) AS k FROM e, refs, g""",
)
def _(spark, folder):
    rows, refs = landmarks(spark, folder)
    kernel = kernels.rbf(kernels.scale_gamma(feats.vector_moments(rows, "embedding")))
    fitted = kernels.KernelFeatures.fit(kernels.reference_set(refs, "vec_id", "embedding").matrix, kernel, centred=False)
    point = kernels.kernel_features_column(rows, F.col("embedding"), fitted, kernel)
    features = checkpoint(rows.select("vec_id", point.alias("p")))
    known = features.join(refs.select("vec_id"), "vec_id", "left_semi")
    products = kernels.kernel_against(features, known, "vec_id", "p", kernels.linear)
    return products.withColumn("k", F.round("k", 5))


@query(
    "correlation_with_gaps",
    """WITH f AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS chars, CASE WHEN quality = 1 THEN toxic END AS toxic_if_good,
      CAST(quality AS DOUBLE) AS quality, 7.0 AS constant FROM documents LEFT JOIN labels USING (doc_id)),
    long AS (SELECT doc_id, 'chars' AS feature, chars AS v FROM f UNION ALL SELECT doc_id, 'toxic_if_good', toxic_if_good FROM f
      UNION ALL SELECT doc_id, 'quality', quality FROM f UNION ALL SELECT doc_id, 'constant', constant FROM f),
    pairs AS (SELECT a.feature AS feature_a, b.feature AS feature_b, a.v AS x, b.v AS y FROM long a JOIN long b USING (doc_id)
      WHERE a.v IS NOT NULL AND b.v IS NOT NULL)
    SELECT feature_a, feature_b, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN round(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)), 6) END AS corr
    FROM pairs GROUP BY ALL""",
)
def _(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    wide = rows.select(
        F.col("n_chars").cast("double").alias("chars"),
        F.when(F.col("quality") == 1, F.col("toxic")).cast("double").alias("toxic_if_good"),
        F.col("quality").cast("double").alias("quality"),
        F.lit(7.0).alias("constant"),
    )
    found = feats.feature_correlation(wide, wide.columns)
    return found.withColumn("corr", r6(F.col("corr")))


@query(
    "split_with_unlabelled",
    """WITH r AS (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)),
    c AS (SELECT quality, count(*) AS n, sum(count(*)) OVER () AS total FROM r GROUP BY quality),
    q AS (SELECT *, total - ceil(total * 0.25) AS train FROM c),
    b AS (SELECT *, floor(n * train / total) AS base, n * train / total - floor(n * train / total) AS rest FROM q),
    x AS (SELECT quality, base + CAST(row_number() OVER (ORDER BY rest DESC, quality NULLS FIRST) <= train - sum(base) OVER () AS INTEGER) AS quota FROM b),
    k AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id)) AS rank FROM r)
    SELECT doc_id, CASE WHEN rank <= quota THEN 'train' ELSE 'test' END AS part
    FROM k JOIN x ON k.quality IS NOT DISTINCT FROM x.quality""",
)
def _(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return splits.stratified_split(rows.select("doc_id", "quality"), "quality", "doc_id").select("doc_id", "part")


@query(
    "price_quantiles",
    """SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 6) AS low,
      round(quantile_cont(l_extendedprice, 0.5), 6) AS middle, round(quantile_cont(l_extendedprice, 0.99), 6) AS high
    FROM lineitem GROUP BY l_returnflag""",
)
def _(spark, folder):
    found = exact_quantiles(table(spark, folder, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.99], ["l_returnflag"])
    return found.select(
        "l_returnflag", "n", *[r6(F.col("quantiles")[i]).alias(c) for i, c in enumerate(("low", "middle", "high"))]
    )


def quality_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embedded documents that have a quality label."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return docs.select(
        F.col("doc_id").cast("string").alias("seq_id"),
        F.col("quality").alias("label"),
        seq.composition(F.col("text")).alias("embedding"),
    )


@query("rbf_svm_baseline")
def _(spark, folder):
    return kernel_svm.rbf_baseline(quality_vectors(spark, folder), "seq_id", "label", "embedding")


SWEEP = kernel_svm.Settings(kernels=("cosine", "rbf"), gamma_factors=(0.5, 1.0, 2.0), centrings=(True, False))


@query("kernel_grid_search")
def _(spark, folder):
    found = kernel_svm.train(quality_vectors(spark, folder), "seq_id", "label", "embedding", SWEEP)
    return kernel_svm.metric_rows(spark, found.metrics)


@query("score_sequences")
def _(spark, folder):
    _, bundle, _ = jobs.train_linear_svm(embedded(spark, folder), feature_cap=32)
    turns = table(spark, folder, "conversations")
    texts = turns.select(F.concat_ws("-", "conv_id", "turn").alias("seq_id"), F.col("text").alias("sequence"))
    return jobs.score_sequences(texts, bundle)


@query("score_kernel_model")
def _(spark, folder):
    rows = quality_vectors(spark, folder)
    bundle = kernel_svm.fit_final(rows, "seq_id", "label", "embedding").bundle(spark)
    docs = table(spark, folder, "documents")
    texts = docs.select(F.col("doc_id").cast("string").alias("seq_id"), seq.composition(F.col("text")).alias("embedding"))
    return jobs.score_kernel_model(texts, bundle)
