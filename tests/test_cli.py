import json

import pytest

from cohortlake.__main__ import main, parser


def test_help_and_unknown_command(capsys):
    for arguments, code in ((["--help"], 0), (["nonsense"], 2)):
        with pytest.raises(SystemExit) as stop:
            parser().parse_args(arguments)
        assert stop.value.code == code


def test_commands_end_to_end(spark, tmp_path, capsys):
    fasta = tmp_path / "in.fa"
    fasta.write_text(">s1\nMKTIIALSYIF\n>s2\nGVVDSGTT\n>s3\nMKTIIALSYIFAA\n>s4\nGVV\n>s5\nMKTIIALSYIFCC\n>s6\nGVVDG\n")
    model, out = str(tmp_path / "model"), str(tmp_path / "preds")
    try:
        main(["embed", str(fasta), "--table", "cli_emb"])
        main(["query", "--table", "cli_emb", "--limit", "2"])
        text = capsys.readouterr().out
        assert text.count("rows=6") == 2 and "s1" in text
        main(["train-linear", "--table", "cli_emb", "--feature-cap", "4", "--out", str(tmp_path / "m"), "--model-out", model])
        assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0])["used_features"] == 4
        main(["predict", str(fasta), "--model", model, "--out", out])
        assert spark.read.csv(out, header=True).count() == 6
        main(["validate", str(fasta), "--sanitize", "--out", str(tmp_path / "v")])
        main(["find", str(fasta), "VV", "KT", "--out", str(tmp_path / "f")])
        assert spark.read.csv(str(tmp_path / "f"), header=True).count() == 6
    finally:
        spark.sql("DROP TABLE IF EXISTS cli_emb")
