import pytest
from pyspark.sql import functions as F

from weftline.sources import annotations
from weftline.sources import fasta, records
from weftline.streaming import ingest

LINES = ["2024-01-01 10:00:00 - INFO - loss iteration=1 value=2.5", "noise", "2024-01-01 10:03:00 - INFO - loss iteration=2 value=1.5", "2024-01-01 10:12:00 - INFO - lr iteration=2 value=nan-ish"]


def test_metric_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(LINES))
    got = records.read_metrics(spark, f"file://{tmp_path}/a.log").orderBy("metric", "iteration").collect()
    assert [(r.metric, r.iteration, r.reading) for r in got] == [("loss", 1, 2.5), ("loss", 2, 1.5), ("lr", 2, None)]


def test_positions(spark):
    t = spark.createDataFrame([("45",), ("45..120",), ("<1..>9",), ("?..9",), ("P1:3..4",), ("",), (None,)], "s string").select(records.position(F.col("s")).alias("p"))
    assert [tuple(r.p) if r.p else None for r in t.collect()] == [(44, 45), (44, 120), (0, 9), None, None, None, None]


def test_codon_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gene,cds,note\ng1,ATGTAA,x\ng2,,y\ng3,ATG,z\n")
    path = f"file://{tmp_path}/a.csv"
    assert [tuple(r) for r in records.read_codon_csv(spark, path, min_codons=2).collect()] == [("g1", "ATGTAA", "x")]
    assert records.read_codon_csv(spark, path, max_codons=1).columns == ["id", "sequence", "note"]
    with pytest.raises(ValueError, match="no column"):
        records.read_codon_csv(spark, path, seq_col="absent")
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no sequence"):
        records.read_codon_csv(spark, f"file://{tmp_path}/b.csv")


def test_fasta_to_jsonl_and_stream(spark, tmp_path):
    rows = [(f"s{i}", "acgt" * (i + 1)) for i in range(9)]
    src, out = f"file://{tmp_path}/fa", f"file://{tmp_path}/jl"
    fasta.write_fasta(spark.createDataFrame(rows, "seq_id string, seq string"), src, width=7)
    assert records.fasta_to_jsonl(spark, src, out, upper=True) == 9
    assert sorted((r.id, r.prompt) for r in spark.read.json(out).collect()) == sorted((i, s.upper()) for i, s in rows)
    for _ in range(2):
        ingest.follow_fasta(spark, src, f"file://{tmp_path}/pq", f"file://{tmp_path}/ck", min_length=8).awaitTermination()
    assert sorted((r.seq_id, r.seq) for r in spark.read.parquet(f"file://{tmp_path}/pq").collect()) == sorted(r for r in rows if len(r[1]) >= 8)


def test_labelled_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"sequence": "ACGT", "label": 1}\n')
    assert [tuple(r) for r in records.read_labelled_jsonl(spark, f"file://{tmp_path}/a.jsonl").collect()] == [("ACGT", 1)]


def test_metric_windows(spark):
    got = ingest.metric_windows(spark.createDataFrame([(x,) for x in LINES], "value string")).orderBy("metric").collect()
    assert [(r.metric, r.n, r["mean"]) for r in got] == [("loss", 2, 2.0), ("lr", 1, None)]


def test_spans_parse_each_entry_once(spark):
    df = spark.createDataFrame([(1, 'DOMAIN 3..9; /note="b"; /note="c"; HELIX <4; REGION ?..7; TURN 2..99'), (2, 'DOMAIN 1..2; /note=""; DOMAIN 5; /note="b"')], "k long, x string")
    found = annotations.spans(df, "k", "x", F.lit(80))
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(1, "DOMAIN:b", 2, 9, 1), (1, "HELIX", 3, 4, 1), (2, "DOMAIN", 0, 2, 1), (2, "DOMAIN:b", 4, 5, 2)}
