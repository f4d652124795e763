import hashlib

import pytest
from pyspark.sql import functions as F

from cohortlake.llm.line_dedup import dedup_lines, drop_runs, kept_text

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """(id, lines, dropped, kept text) of each row, by the contract and nothing else."""
    keys = [[line.strip(BLANKS).translate(LOWER) for line in (t or "").split("\n")] for _, t in rows]
    holder = {}
    for (i, _), own in zip(rows, keys):
        for key in own:
            if len(key) >= 10 and i is not None:
                holder[key] = min(i, holder.get(key, i))
    out = []
    for (i, t), own in zip(rows, keys):
        lines = (t or "").split("\n")
        keep = [n for n, key in enumerate(own) if len(key) < 10 or key not in holder or (i is not None and holder[key] >= i)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(lines[n] for n in keep)))
    return sorted(out, key=str)


ROWS = [
    (1, "A shared line here\nshort\nunique to the first document"),
    (2, "  a SHARED line here \t\nshort\n\n"),
    (3, "a shared line here\na shared line here\nÄußerst ÄHNLICHE Zeile\nlast"),
    (4, "Äußerst äHNLICHE Zeile\nÄußerst ÄHNLICHE zeile"),
    (5, None),
    (6, ""),
    (7, "only one line in here\n" * 40),
    (8, "only one line in here\nand more of its own"),
    (9, "\n".join(f"long document line number {i}" for i in range(5000))),
    (10, "\n".join(f"long document line number {i}" for i in range(0, 5000, 3)) + "\n\ntail"),
    (None, "a shared line here\nonly nameless rows hold this"),
    (None, "only nameless rows hold this"),
    (2, "  a SHARED line here \t\nshort\n\n"),
    (8, "another text with the same identifier\nA shared line here"),
]


@pytest.mark.parametrize("hot", [0, 1, 256])
def test_matches_brute_force(spark, hot):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("pos", F.lit("x"))
    found = dedup_lines(df.repartition(5), hot_lines=max(1, hot), tracked=4096)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found.collect()), key=str)
    assert got == brute(ROWS)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs(spark):
    df = spark.createDataFrame([([0, 1, 4],), ([2],), ([0],)], "at array<int>")
    assert [r[0] for r in df.select(drop_runs(F.col("at"))).collect()] == [[0, 2, 2, 1], [2, 1], [0, 1]]
    df = spark.createDataFrame([("a\nb\nc\nd\ne\nf", [0, 2, 2, 1])], "t string, r array<int>")
    assert df.select(kept_text(F.col("t"), F.col("r"))).first()[0] == "c\nd\nf"


def test_no_python_in_the_plan(spark):
    plan = dedup_lines(spark.createDataFrame(ROWS, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "rangepartitioning" in plan


def test_digest_is_of_the_kept_text(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    rows = dedup_lines(df).select("kept", F.sha2("kept", 256).alias("d")).collect()
    assert all(r.d == hashlib.sha256(r.kept.encode()).hexdigest() for r in rows)
