"""Golden cases of mathematical equality, extraction, option types and cleaning."""

import pytest
from pyspark.sql import functions as F

from loomwork.functions import answers, equivalence, ngrams, records, text
from loomwork.operators import build


def pairs(spark, rows, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    return [r[1] for r in sorted(df.select("i", column(F.col("a"), F.col("b")).alias("x")).collect())]


EQUAL = [
    ("0.5", "1/2"), ("1.000", "1"), ("x=5", "5"), (r"\dfrac{1}{2}", r"\frac12"), ("1,000", "1000"), (None, None), (r"\text{(A)}", "A"), ("3j", "3i"),
    (r"\left( 1, 2 \right)", "(1,2)"), (r"5\text{ cm}", "5"), (r"$\frac{3}{4}$", "3/4"), (".5", "0.5"), (r"90^\circ", "90"), ("the answer is: 7", "7"),
    (r"\sqrt2", r"\sqrt{2}"), ("12 dollars", "12"), (r"10\%", "10"), ("", ""), (r"\boxed{4}", "4"),
]
DIFFERENT = [(None, "1"), ("1", None), ("2", "3"), ("1/3", "1/2"), ("ab", "ba"), ("(1,2)", "(2,1)"), ("", "1")]


def test_equivalence(spark):
    got = pairs(spark, EQUAL + DIFFERENT, equivalence.is_equivalent)
    assert got == [True] * len(EQUAL) + [False] * len(DIFFERENT)


def test_extraction_by_method(spark):
    rows = [(r"\boxed{{B}}", "B"), ("b.", "B"), ("The answer is B, not A.", "B"), ("answer: Paris", "Paris"), (r"\boxed{1", "1"), ("  x ", "x")]
    get = lambda m: pairs(spark, rows, lambda t, r: answers.extract(t, r, m))
    assert get("boxed") == ["B", None, None, None, None, None]
    assert get("exact") == [r"\boxed{{B}}", "b.", "The answer is B, not A.", "answer: Paris", r"\boxed{1", "x"]
    assert get("knowledge") == ["B", "B", None, "Paris", r"\boxed{1", "X"]  # a reference of one letter makes a choice
    assert get("other") == ["B", "b.", "The answer is B, not A.", "answer: Paris", r"\boxed{1", "x"]
    right = lambda m, given: pairs(spark, given, lambda t, r: answers.correct(t, r, m))
    assert right("knowledge", [("b", " B "), ("C", "B"), (None, "B"), ("Rome!", '["Paris", "rome"]'), ("1/2", "0.5")]) == [True, False, False, True, False]
    assert right("boxed", [("1/2", "0.5"), (None, "1")]) == [True, False]


@pytest.mark.parametrize(
    ("given", "kind"),
    [
        ("3/4", "numeric"), ("5 mol/L", "numeric"), ("1,234", "numeric"), ("-3.5 kg", "numeric"), ("1,234,567", "phrase"), ("Albert camus", "short_entity"),
        ("A B C D E", "phrase"), ("Yes.", "phrase"), ("1945", "year"), (" 2100 ", "year"), ("2101", "numeric"), ("", "phrase"), (None, "phrase"),
    ],
)
def test_option_type(spark, given, kind):
    assert pairs(spark, [(given, "")], lambda a, b: text.option_type(a)) == [kind]


def test_cleaning(spark):
    rows = [("Justification: x", ""), ("Answer - x", ""), ("<think>a\nb</think>\n REASONING: x\n\n\n\ny", ""), ("explanation x", "")]
    assert pairs(spark, rows, lambda a, b: text.think_strip(a)) == ["x", "x", "x\n\ny", "explanation x"]


def test_ngrams_and_normal_form(spark):
    grams = pairs(spark, [("abcdef", ""), ("abc", ""), ("a  b\nc d", ""), ("", "")], lambda a, b: F.array_join(F.array_sort(text.char_ngrams(a)), "|"))
    assert grams == ["abcde|bcdef", "abc", " b c |a b c|b c d", ""]
    rows = [(r"Find $x \left( 1 , 2 \right)$", ""), ("ﬁve ½", ""), (None, ""), ("a − b", "")]
    assert pairs(spark, rows, lambda a, b: ngrams.normal_problem(a)) == ["find x(1,2)", "five 1⁄2", "none", "a-b"]
    near = [("the quick brown fox jumps over the lazy dog " * 5, ""), ("the quick brown fox jumps over the lazy dog " * 5 + "x", "")]
    df = spark.createDataFrame(near, "a string, b string").select(ngrams.signature(F.col("a")).alias("s"))
    one, two = (r.s for r in df.collect())
    assert len(one) == 64 and sum(a == b for a, b in zip(one, two, strict=True)) > 50


def test_lettered_prompt_is_read_back(spark):
    prompt = "What?\nReally?\n\nA) one\nB) two\n\nC) three"
    p = spark.createDataFrame([(prompt, "B")], "p string, a string").select(records.parse_lettered(F.col("p"), F.col("a")).alias("x")).first().x
    assert (p.question, p.gold, list(p.others)) == ("What?\nReally?", "two", ["one", "three"])


def test_quota_plan():
    quotas = {"a": 0.5, "b": 0.3, "c": 0.2}
    take, short = build.quota_plan({("a", False): 100, ("a", True): 100, ("b", False): 5, ("b", True): 4, ("c", False): 50}, 101, quotas, 0.2)
    assert take["a", False] + take["a", True] == 51 and take["a", True] == 10
    assert take["b", False] == 5 and take["b", True] == 4 and short == 30 - 9 and take["c", False] == 20


def test_rebalance(spark):
    rows = [(i, "it" if i % 3 else "zh", [f"o{j}" for j in range(1 + i % 20)] + ["o0"]) for i in range(600)]
    got = build.rebalance(spark.createDataFrame(rows, "idx long, lang string, choices array<string>"), "lang", 7).collect()
    again = build.rebalance(spark.createDataFrame(rows, "idx long, lang string, choices array<string>").repartition(3), "lang", 7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    own = {i: set(c) for i, _, c in rows}
    assert len({r.idx for r in got}) == len(got) > 300
    for r in got:
        assert len(r.kept) == r.target - 1 and set(r.kept) | set(r.ignored) == own[r.idx] and not set(r.kept) & set(r.ignored)
    counts = {}
    for r in got:
        counts[r.lang, r.target] = counts.get((r.lang, r.target), 0) + 1
    assert max(counts, key=counts.get)[1] in (3, 4, 5) and {t for _, t in counts} == set(range(2, 21))
