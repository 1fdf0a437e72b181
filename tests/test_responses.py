"""Small cases of response functions and selection operators."""

import pytest
from pyspark.sql import functions as F

from loomwork.functions import responses
from loomwork.operators import selection


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"v{i} string" for i in range(len(values))))
    return df.select(column(*(F.col(f"v{i}") for i in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("response", "expected"),
    [
        (None, None),
        ("", None),
        ("\\boxed{A}", None),
        ("x</think>", None),
        ("x</THINK> \\boxed{a} then \\boxed{(c)}", "C"),
        ("x</think>\\boxed{\\text{B}}", "B"),
        ("x</think>My final answer is: **d", "D"),
        ("x</think>**B** " + "y" * 500, None),
        ("x</think>" + "y " * 500 + "**B**", "B"),
        ("x</think>**C. the sea**", "C"),
    ],
)
def test_letter(spark, response, expected):
    assert one(spark, responses.letter, response) == expected


@pytest.mark.parametrize(
    ("answer", "reference", "expected"),
    [
        ("The final answer is Paris.", "paris", True),
        ("Rome", '["Paris", "rome!"]', True),
        ("5", "5", True),
        ("", "x", False),
        (None, "x", False),
        ("x", None, False),
        ("None", "[null]", True),
    ],
)
def test_direct_match(spark, answer, reference, expected):
    assert one(spark, responses.direct_match, answer, reference) is expected


@pytest.mark.parametrize(
    ("text", "gold", "expected"),
    [
        (None, "x", "too_short"),
        ("a" * 199, "x", "too_short"),
        ("[" + "a" * 300, "x", "list_format_prefix"),
        ("word " * 2000, "x", "too_long"),
        ("so it goes 'a', 'b' " + "b " * 100, "x", "list_format_separator"),
        ("As an AI I " + "b " * 100, "x", "refusal"),
        ("``` " + "b " * 100, "x", "bad_pattern"),
        (" ".join(f"w{i}" for i in range(90)), "zebra", "no_gold_mention"),
        (" ".join(f"w{i}" for i in range(90)), "w8", None),
        (" ".join(f"w{i}" for i in range(90)), "w 8 zebra w9", None),
        (" ".join(f"w{i}" for i in range(90)), "yes, no", None),
        (" ".join(f"w{i}" for i in range(90)) + " indeed", "yes", None),
        ("sea and sky " * 30, "sea", "repetitive(reps=30)"),
    ],
)
def test_gate_reason(spark, text, gold, expected):
    assert one(spark, responses.gate_reason, text, gold) == expected


def samples(spark, rows):
    return spark.createDataFrame(rows, "qid long, attempt long, text string, letter string, right boolean")


def test_pairs_take_longest_right_and_first_lettered_wrong(spark):
    df = samples(spark, [
        (1, 0, "aa", "A", True), (1, 1, "aaaa", "A", True), (1, 2, "bbbb", "A", True), (1, 3, "n", None, False), (1, 4, "w", "B", False),
        (2, 0, "a", "A", True), (2, 1, "x" * 8000, None, False),
        (3, 0, "b", "B", False), (3, 1, "b", None, None),
    ])
    assert [tuple(r) for r in selection.preference_pairs(df, "qid").collect()] == [(1, "aaaa", "w")]
    out = {r["qid"]: r["outcome"] for r in selection.drawn_pairs(df, "qid", F.md5("text"), 10).collect()}
    assert out == {1: "pair", 2: "no_incorrect", 3: "no_correct"}
    assert {tuple(r) for r in selection.first_accepted(df, "qid").collect()} == {(1, 1, "aa"), (2, 1, "a"), (3, 2, None)}
    assert selection.preference_pairs(samples(spark, []), "qid").count() == 0


def test_token_f1(spark):
    df = spark.createDataFrame([(1, "a a b", "a b b"), (2, "", None), (3, "a", ""), (4, "x", "y")], "k long, l string, r string")
    got = {r["k"]: round(r["f1"], 6) for r in selection.token_f1(df, "k", "l", "r").collect()}
    assert got == {1: 0.666667, 2: 1.0, 3: 0.0, 4: 0.0}
