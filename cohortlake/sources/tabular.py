"""CSV / TSV scans with name resolution, and dispatch by file suffix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlake.functions.sequence import top_enzyme_class
from cohortlake.operators.features import coerced, numeric_columns, quoted
from cohortlake.session import sized
from cohortlake.sources.fasta import read_fasta

# Accepted column names and file suffixes.
SEQUENCE_NAMES = ("sequence", "seq", "aa_sequence", "protein_sequence")
ID_NAMES = ("id", "seq_id", "name", "accession")
# Accepted column names of an enzyme map.
ENZYME_ID_NAMES = ("accession", "entry")
ENZYME_CLASS_NAMES = ("ec", "ec number")
FASTA_SUFFIXES = (".fa", ".fasta", ".fna")


def resolve(columns: Sequence[str], accepted: Sequence[str]) -> str | None:
    """First column, in file order, whose lower-cased name is accepted."""
    return next((c for c in columns if c.lower() in accepted), None)


def in_file_order(df: DataFrame, path: str, block: str, seq: str, out: str) -> DataFrame:
    """Number rows 1..n in file order, given each row's file, block start and increasing row id.

    Only row counts per block are ordered globally; the rows themselves stay where they are read.
    """
    blocks = df.groupBy(path, block).agg(F.count(F.lit(1)).alias("__n"), F.min(seq).alias("__first"))
    order = Window.orderBy(path, block)
    blocks = blocks.withColumn("__before", F.sum("__n").over(order) - F.col("__n")).drop("__n")
    return df.join(sized(blocks), [path, block]).withColumn(
        out, F.col("__before") + F.col(seq) - F.col("__first") + 1
    ).drop("__before", "__first")


def with_synthetic_ids(df: DataFrame, out: str = "seq_id") -> DataFrame:
    """Add ``seq_1 … seq_n`` in file order to a DataFrame read straight from files."""
    located = df.select(
        "*",
        F.col("_metadata.file_path").alias("__path"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__seq"),
    )
    numbered = in_file_order(located, "__path", "__block", "__seq", "__row")
    return numbered.withColumn(out, F.concat(F.lit("seq_"), F.col("__row"))).drop("__path", "__block", "__seq", "__row")


def read_sequence_csv(spark: SparkSession, paths: str | Sequence[str], ordered: bool = False) -> DataFrame:
    """``(seq_id, sequence)`` from a CSV with a sequence column; ids are made up when absent.

    ``ordered`` adds ``file_order`` (path, block, row).
    """
    raw = spark.read.csv(paths, header=True)
    sequence = resolve(raw.columns, SEQUENCE_NAMES)
    if sequence is None:
        raise ValueError(f"no column of the CSV is named like a sequence: {', '.join(SEQUENCE_NAMES)}")
    ident = resolve(raw.columns, ID_NAMES)
    if ident is None:
        raw, ident = with_synthetic_ids(raw, "__id"), "__id"
    place = F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )
    if ordered and ident != "__id":
        raw = raw.withColumn("file_order", place)
    elif ordered:
        raw = raw.withColumn("file_order", F.substring("__id", 5, 20).cast("long"))
    kept = ["file_order"] if ordered else []
    return raw.select(quoted(ident).alias("seq_id"), F.coalesce(quoted(sequence), F.lit("")).alias("sequence"), *kept)


def read_sequences(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """FASTA for ``.fa .fasta .fna``, CSV otherwise; an empty input is an error."""
    reader = read_fasta if path.lower().endswith(FASTA_SUFFIXES) else read_sequence_csv
    sequences = reader(spark, path, ordered=ordered)
    if sequences.isEmpty():
        raise ValueError(f"{path} holds no sequence records")
    return sequences


def read_labels_csv(spark: SparkSession, paths: str | Sequence[str], label: str) -> DataFrame:
    """``(seq_id, label)``, one row per id; a repeated id keeps its last row."""
    raw = spark.read.csv(paths, header=True)
    ident = resolve(raw.columns, ID_NAMES)
    if ident is None:
        raise ValueError("labels CSV must have a seq_id/id/name/accession column")
    if label not in raw.columns:
        raise ValueError(f"there is no column '{label}' to take the label from")
    # File order decides which duplicate is the last one.
    rows = raw.select(
        quoted(ident).alias("seq_id"),
        quoted(label).alias("label"),
        F.struct(
            F.col("_metadata.file_path").alias("f"),
            F.col("_metadata.file_block_start").alias("b"),
            F.monotonically_increasing_id().alias("r"),
        ).alias("__at"),
    )
    return rows.groupBy("seq_id").agg(F.max_by("label", "__at").alias("label"))


def read_enzyme_map(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(accession, ec_top)`` from a TSV, classes 1 to 6; columns by name, else by position."""
    raw = spark.read.csv(paths, sep="\t", header=True)
    ident, annotation = (
        resolve(raw.columns, accepted) or raw.columns[position]
        for position, accepted in enumerate((ENZYME_ID_NAMES, ENZYME_CLASS_NAMES))
    )
    rows = raw.select(
        quoted(ident).alias("accession"),
        top_enzyme_class(quoted(annotation)).alias("ec_top"),
        F.struct(
            F.col("_metadata.file_path").alias("f"),
            F.col("_metadata.file_block_start").alias("b"),
            F.monotonically_increasing_id().alias("r"),
        ).alias("__at"),
    )
    valid = rows.filter(F.col("ec_top").between(1, 6))
    return valid.groupBy("accession").agg(F.max_by("ec_top", "__at").alias("ec_top"))


def read_feature_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    id_col: str,
    label_col: str,
    feature_cols: Sequence[str] | None = None,
    group_col: str | None = None,
    schema: StructType | None = None,
) -> tuple[DataFrame, list[str]]:
    """``(sample_id, label, group_id, features…)`` and the feature names in table order.

    Named features are read as text and coerced; otherwise all numeric and boolean columns except
    the id, label and group are used. Finding those needs a typing pass unless ``schema`` is given.
    """
    if schema is not None:
        raw = spark.read.csv(paths, header=True, schema=schema)
    else:
        raw = spark.read.csv(paths, header=True, inferSchema=not feature_cols)
    for kind, name in (("id", id_col), ("label", label_col)):
        if name not in raw.columns:
            raise ValueError(f"there is no column '{name}' to take the {kind} from")
    if feature_cols:
        features = list(feature_cols)
        missing = [c for c in features if c not in raw.columns]
        if missing:
            raise ValueError(f"these features are no columns of the table: {missing}")
    else:
        features = numeric_columns(raw, [id_col, label_col, *([group_col] if group_col else [])])
        if not features:
            raise ValueError("the table has no number column to use as a feature; list the features")
    group = group_col if group_col and group_col in raw.columns else id_col
    table = raw.select(
        quoted(id_col).cast("string").alias("sample_id"),
        quoted(label_col).cast("string").alias("label"),
        quoted(group).cast("string").alias("group_id"),
        *[coerced(quoted(f)).alias(f) for f in features],
    )
    return table, features


def read_predictions(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Predictions CSV, or ``None`` when there is none."""
    if not path:
        return None
    try:
        return spark.read.csv(path, header=True, inferSchema=True)
    except Exception as error:  # the reader reports a missing path by error class only
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
