"""Golden cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from loomwork.functions import answers, text
from loomwork.operators import rows
from loomwork.sources import files


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        (r"x \boxed{4}", "4"), (r"\boxed{\frac{1}{2}}", r"\frac{1}{2}"), (r"\boxed{1} then \boxed{2}", "2"), (r"\fbox{3}", "3"),
        (r"\boxed {A}", None), (r"\boxed{1", None), ("none", None), (None, None),
    ],
)
def test_boxed(spark, given, expected):
    assert one(spark, answers.boxed, given) == expected


@pytest.mark.parametrize(("given", "expected"), [("(B)", "B"), ("b.", "B"), ("The answer is C", "C"), ("A or B", None)])
def test_choice_label(spark, given, expected):
    assert one(spark, answers.choice_label, given) == expected


@pytest.mark.parametrize(("n", "c", "k", "p"), [(8, 0, 8, 0.0), (8, 1, 8, 1.0), (8, 3, 1, 0.375), (4, 1, 2, 0.5)])
def test_pass_at_k(spark, n, c, k, p):
    df = spark.createDataFrame([(n, c)], "n int, c int")
    assert df.select(answers.pass_at_k(F.col("n"), F.col("c"), k)).first()[0] == pytest.approx(p)


def test_uid_and_types(spark):
    assert one(spark, text.stable_uid, "  Hello   World ") == "b94d27b9934d3e08"
    kinds = {"1945": "year", "2100": "year", "3.5 kg": "numeric", "1,234": "numeric", "2500": "numeric", "Paris": "short_entity",
             "New York City": "short_entity", "the cat": "phrase", "Paris, France": "phrase", "1,234,567": "phrase", "": "phrase"}
    for given, expected in kinds.items():
        assert one(spark, text.option_type, given) == expected, given
    assert one(spark, text.think_strip, "<think>x</think>Explanation: y") == "y"
    buckets = spark.range(1, 26).select(text.k_bucket(F.col("id"))).collect()
    assert [b[0] for b in buckets[:6]] == ["2", "2", "3", "4", "5", "6-10"] and buckets[-1][0] == "11-20"


def test_caps_are_not_seen(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "k string, o long")
    b = spark.createDataFrame([("z", 4), ("x", 5)], "k string, o long")
    got = rows.capped_first_wins([a, b], "k", "o", 2)
    assert sorted(map(tuple, got.collect())) == [("x", 1), ("y", 2), ("z", 4)]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    good, bad = files.jsonl_lenient(spark, str(tmp_path / "a.jsonl"), "a long")
    assert sorted(r.a for r in good.collect()) == [1, 2] and bad.count() == 1
    with pytest.raises(Exception):  # noqa: B017
        files.jsonl_strict(spark, str(tmp_path / "a.jsonl"), "a long").collect()
