import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortlake.plans import jobs
from cohortlake.sources import tabular
from cohortlake.sources.fasta import read_clean_fasta, read_fasta

EDGES = "junk\n>a d\nMK\n\nTI\n>b\r\nGV\r\n  >c z\nac gt\n>empty\n>e\nA>B\n"


def write(path, text):
    with open(path, "w", newline="", encoding="utf-8") as handle:
        handle.write(text)
    return str(path)


def plain_reader(text):
    """Line-by-line restatement of the format, for comparison only."""
    out, ident, body = [], None, []
    for line in text.replace("\r\n", "\n").split("\n"):
        line = line.strip()
        if line.startswith(">"):
            if ident is not None:
                out.append((ident, "".join(body)))
            ident, body = line[1:].split()[0], []
        elif line:
            body.append(line)
    return out + ([(ident, "".join(body))] if ident is not None else [])


def test_fasta_edges(spark, tmp_path):
    path = write(tmp_path / "x.fa", EDGES)
    rows = [tuple(r) for r in read_fasta(spark, path).collect()]
    assert sorted(rows) == sorted([("a", "MKTI"), ("b", "GV"), ("c", "ac gt"), ("empty", ""), ("e", "A>B")])


def test_bare_header_is_an_error(spark, tmp_path):
    with pytest.raises(PySparkException, match="without an identifier"):
        read_fasta(spark, write(tmp_path / "bare.fa", ">\nMK\n")).collect()


@pytest.mark.parametrize("split_bytes", [64, 333, 4096, 1 << 20])
def test_fasta_is_split_safe(spark, tmp_path, split_bytes):
    rng = random.Random(split_bytes)
    expected = []
    for k, (newline, junk) in enumerate([("\n", ""), ("\n", "no header\nyet\n"), ("\r\n", ""), ("\r\n", "x > y\r\n")]):
        parts = [junk]
        for i in range(120):
            indent = "  " if rng.random() < 0.1 else ""
            lines = ["".join(rng.choice("ACDE>K ") for _ in range(rng.randint(1, 30))).lstrip("> ") for _ in range(rng.randint(0, 4))]
            parts.append(newline.join([f"{indent}>r{k}_{i} desc", *lines, ""]))
        text = "".join(parts)
        write(tmp_path / f"f{k}.fa", text)
        expected += plain_reader(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        rows = [tuple(r) for r in read_fasta(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(rows) == sorted(expected)


def test_header_first_agrees_on_regular_files(spark, tmp_path):
    path = write(tmp_path / "r.fa", ">a\nMK\n>b\nGV\nAA\n")
    assert sorted(map(tuple, read_fasta(spark, path, header_first=True).collect())) == [("a", "MK"), ("b", "GVAA")]


def test_clean_fasta(spark, tmp_path):
    text = "x\n>sp|P1|N d\nmk-v 1\n  >q\nAA\n>tr|Q2|N\n>P3 z\nac\n"
    rows = sorted(map(tuple, read_clean_fasta(spark, write(tmp_path / "c.fa", text)).collect()))
    # An indented mark is sequence text here, and a record without sequence lines is dropped.
    assert rows == [("P1", "MKVQAA"), ("P3", "AC")]


def test_sequence_csv(spark, tmp_path):
    path = write(tmp_path / "s.csv", "Other,Name,AA_Sequence,seq\n1,x,MK,zz\n2,y,GV,zz\n")
    assert sorted(map(tuple, tabular.read_sequences(spark, path).collect())) == [("x", "MK"), ("y", "GV")]
    path = write(tmp_path / "n.csv", "sequence\n" + "".join(f"S{i}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        rows = {r["sequence"]: r["seq_id"] for r in tabular.read_sequences(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == {f"S{i}": f"seq_{i + 1}" for i in range(500)}
    with pytest.raises(ValueError, match="sequence"):
        tabular.read_sequences(spark, write(tmp_path / "bad.csv", "a,b\n1,2\n"))
    with pytest.raises(ValueError, match="holds no sequence"):
        tabular.read_sequences(spark, write(tmp_path / "empty.csv", "id,sequence\n"))


def test_labels_csv_last_row_wins(spark, tmp_path):
    path = write(tmp_path / "l.csv", "ACCESSION,kind\na,1\nb,2\na,3\n")
    assert sorted(map(tuple, tabular.read_labels_csv(spark, path, "kind").collect())) == [("a", "3"), ("b", "2")]
    with pytest.raises(ValueError, match="take the label from"):
        tabular.read_labels_csv(spark, path, "nope")
    with pytest.raises(ValueError, match="must have"):
        tabular.read_labels_csv(spark, write(tmp_path / "m.csv", "k,kind\na,1\n"), "kind")


def test_enzyme_map(spark, tmp_path):
    named = write(tmp_path / "m.tsv", "x\tEC number\tEntry\n1\t3.4.1.-; 1.1.1.1\tP1\n1\tn/a\tP2\n1\t7.1.1.1\tP3\n")
    assert [tuple(r) for r in tabular.read_enzyme_map(spark, named).collect()] == [("P1", 3)]
    positional = write(tmp_path / "p.tsv", "k\tv\nP9\t2.1\nP9\t4.1\n")
    assert [tuple(r) for r in tabular.read_enzyme_map(spark, positional).collect()] == [("P9", 4)]


def test_feature_csv_columns(spark, tmp_path):
    path = write(tmp_path / "w.csv", "pid,status,grp,a.b|c,flag,note\n1,x,7,1.5,true,t\n2,y,8,2.5,false,u\n")
    table, features = tabular.read_feature_csv(spark, path, "pid", "status", group_col="grp")
    assert features == ["a.b|c", "flag"]
    assert sorted(map(tuple, table.collect())) == [("1", "x", "7", 1.5, 1.0), ("2", "y", "8", 2.5, 0.0)]
    with pytest.raises(ValueError, match="no columns of the table"):
        tabular.read_feature_csv(spark, path, "pid", "status", ["zz"])
    with pytest.raises(ValueError, match="take the id from"):
        tabular.read_feature_csv(spark, path, "id", "status")
    with pytest.raises(ValueError, match="take the label from"):
        tabular.read_feature_csv(spark, path, "pid", "nope")


def test_missing_predictions(spark, tmp_path):
    assert tabular.read_predictions(spark, None) is None
    assert tabular.read_predictions(spark, str(tmp_path / "absent.csv")) is None
    path = write(tmp_path / "p.csv", "seq_id,prediction\na,1\n")
    assert tabular.read_predictions(spark, path).filter(F.col("prediction") == 1).count() == 1


def test_limits_follow_the_file_order(spark, tmp_path):
    fasta = write(tmp_path / "o.fa", ">z\nMK\n>a\nGV\n>m\nAC\n")
    with_ids = write(tmp_path / "o.csv", "id,sequence\nz,MK\na,GV\nm,AC\n")
    without = write(tmp_path / "p.csv", "sequence\n" + "MK\n" * 12)
    for path, first in ((fasta, ["z", "a"]), (with_ids, ["z", "a"]), (without, ["seq_1", "seq_2"])):
        rows = tabular.read_sequences(spark, path, ordered=True)
        assert sorted(r["seq_id"] for r in jobs.validate_sequences(rows, limit=2).collect()) == sorted(first)
