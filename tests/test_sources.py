"""File sources, sinks and the loader registry on small files."""

import json

import pytest
from pyspark.sql import functions as F

from loomwork.functions import records
from loomwork.operators import rows
from loomwork.sources import files, loaders


def test_numbered_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    got = files.jsonl_numbered(spark, str(tmp_path / "a.jsonl"), "a long").collect()
    assert sorted((r.line_no, r.a) for r in got) == [(1, 1), (4, 2)]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{bad\n')
    with pytest.raises(Exception):  # noqa: B017
        files.jsonl_numbered(spark, str(tmp_path / "b.jsonl"), "a long").collect()


def test_keyed_answers(spark, tmp_path):
    (tmp_path / "answers.json").write_text(json.dumps({"1": {"answer": 0}, "22": {"answer": 19}}))
    answers = files.answer_table(spark, str(tmp_path / "answers.json"))
    q = spark.createDataFrame([(1, "x"), (22, "y")], "id long, q string")
    assert {(r.id, r.answer) for r in files.with_answers(q, answers).collect()} == {(1, "A"), (22, "T")}
    with pytest.raises(Exception, match="no answer"):
        files.with_answers(q.unionByName(spark.createDataFrame([(3, "z")], q.schema)), answers).collect()


def test_runs_and_scored_files(spark, tmp_path):
    detail = {"index": 0, "n": 2, "c": 1, "completions": [{"extracted": "1", "correct": True}, {"extracted": None, "correct": False}]}
    scored = {"benchmark_method": "boxed", "n_problems": 1, "metrics": {"pass@1": 0.5}, "detailed_results": [detail]}
    for run, more in (("r1/checkpoint-50", {}), ("r2/final", {"box_compliance": 0.25}), ("odd", {})):
        folder = tmp_path / run
        folder.mkdir(parents=True)
        (folder / "scored.json").write_text(json.dumps(scored | {"metrics": scored["metrics"] | more}))
    found = files.runs_below(spark, str(tmp_path), "scored.json", r"/(r\d)/(checkpoint-(\d+)|final)/", run=1, checkpoint=2, step=3)
    assert {(r.run, r.checkpoint, r.step) for r in found.collect()} == {("r1", "checkpoint-50", "50"), ("r2", "final", "")}
    rates = {r.file.split("/")[-2]: r.box_compliance for r in files.scored_metrics(spark, f"{tmp_path}/*/*/scored.json").collect()}
    assert rates == {"checkpoint-50": 0.5, "final": 0.25}
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="not a scored file"):
        files.scored_metrics(spark, f"{tmp_path}/bad.json").collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", "a"), (1, "é", "a"), (2, "b", "b")], "k long, t string, part string")
    at = str(tmp_path / "out")
    files.write_jsonl(df, f"{at}/j")
    assert spark.read.json(f"{at}/j").where("t = 'é'").count() == 2
    assert files.append_new(spark, df, f"{at}/p", "k").count() == 2
    assert files.append_new(spark, df.union(spark.createDataFrame([(3, "c", "c")], df.schema)), f"{at}/p", "k").count() == 1
    assert spark.read.parquet(f"{at}/p").count() == 3
    files.write_chunks(df, f"{at}/c", "part")
    files.write_chunks(df.where("part = 'b'").withColumn("t", F.lit("new")), f"{at}/c", "part")
    assert {(r.k, r.t, r.part) for r in spark.read.parquet(f"{at}/c").collect()} == {(1, "é", "a"), (2, "new", "b")}
    files.write_csv(df, f"{at}/v", ["t", "k"])
    assert spark.read.option("header", True).csv(f"{at}/v").columns == ["t", "k"]
    with pytest.raises(ValueError):
        files.write_csv(df, f"{at}/w", ["t"], most=2)
    report = files.write_report(spark, {"counts": df.groupBy("part").count()}, f"{at}/r")
    assert json.loads("\n".join(r.value for r in spark.read.text(f"{at}/r").collect())) == report


def test_failing_source_is_left_out(spark, tmp_path):
    good = spark.createDataFrame([("a", True), ("b?", None), (None, True)], "question string, answer boolean")
    (tmp_path / "x.jsonl").write_text("{broken\n")
    bad = files.jsonl_strict(spark, str(tmp_path / "x.jsonl"), "question string, choices array<string>, answer int, subject string")
    out, failed = loaders.load_sources({"boolq": good, "mmlu": bad, "ecqa": good})
    assert [(r.question, r.gold_idx, r.source_ord) for r in out.collect()] == [("a?", 0, 4)]
    assert set(failed) == {"mmlu", "ecqa"}
    assert loaders.boolq(good)[1].count() == 2
    assert loaders.first_valid(loaders.boolq(good)[0], 5, "uid").count() == 1


def test_parsed_parameters(spark):
    assert records.count_spec("1-3, 7,,") == {1, 2, 3, 7}
    assert records.quota_spec("a=1,b=3") == {"a": 0.25, "b": 0.75} and sum(records.quota_spec(None).values()) == pytest.approx(1)
    assert records.limit_spec(["x=3"]) == {"x": 3}
    with pytest.raises(ValueError):
        records.limit_spec(["x"])
    df = spark.createDataFrame([(None, "", "5"), ("", None, None)], "category string, type string, level string")
    assert records.present_field(df, ["category", "type", "level"]) == "level"
    with pytest.raises(ValueError):
        records.present_field(df, ["category", "type"])


def test_keys_and_positions(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "at long, v string")
    with pytest.raises(Exception, match="differ in length"):
        rows.by_position(a, a.limit(1).withColumnRenamed("v", "w"), "at").collect()
    with pytest.raises(Exception, match="repeats"):
        rows.require_unique(a.union(a), "at").collect()
    assert rows.require_unique(a, "at").count() == 2
    many = spark.range(100).selectExpr("id", "CASE WHEN id < 70 THEN NULL ELSE id % 2 END AS g")
    got = rows.numbered(many, ["g"], [F.col("id")]).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.id):
        by.setdefault(r.g, []).append((r["rank"], r.total))
    assert all(v == [(i + 1, len(v)) for i in range(len(v))] for v in by.values()) and len(got) == 100
