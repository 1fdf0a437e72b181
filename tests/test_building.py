"""Draws of options and choice counts: whole lists, even chances, exact plans."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from loomwork.plans import building
from loomwork import plans as registered
from loomwork.operators import build
from loomwork.plans import catalog
from loomwork.workspace import Workspace

registered.load_all()


def test_step_primes_are_prime_and_reach_every_place():
    primes = build.step_primes(8)
    assert len(set(primes)) == 8 and all(p > 1 << 31 and all(p % d for d in range(3, 46_400, 2)) for p in primes)
    for n in (1, 2, 12, 513, 2000):
        for p in primes:
            assert len({(5 + i * (p % n)) % n for i in range(n)}) == n


def questions(spark, n, need):
    rows = [(i, "macro", None, [f"own {i}", "Right Answer"], "Right Answer", need) for i in range(n)]
    return spark.createDataFrame(rows, "qid long, macro_cat string, source string, options array<string>, gold string, need int")


def test_every_option_of_a_long_list_is_drawn(spark):
    q = questions(spark, 6000, 4)
    pool = spark.range(2000).select(F.lit("macro").alias("macro_cat"), F.lit("short_entity").alias("type"), F.concat(F.lit("Name "), F.col("id").cast("string")).alias("option"), F.lit("s").alias("subject"))
    drawn = build.distractors(q, pool, 5).collect()
    per = collections.Counter(r.option for r in drawn)
    assert len(drawn) == 24_000 and len(per) == 2000
    assert max(per.values()) < 12 * 4  # twelve a piece, if all are as likely
    together = collections.defaultdict(set)
    for r in drawn:
        together[r.qid].add(int(r.option.split()[1]))
    assert all(len(s) == 4 for s in together.values())
    assert len({frozenset(s) for s in together.values()}) > 5700  # an order of its own for each question


def test_short_lists_are_used_up_and_case_counts_once(spark):
    q = questions(spark, 3, 5)
    pool = spark.createDataFrame([("macro", "short_entity", o, "s") for o in ("Abc", "ABC", "Def", "RIGHT ANSWER", "Own 1", "Ghi")], "macro_cat string, type string, option string, subject string")
    got = collections.defaultdict(list)
    for r in build.distractors(q, pool, 1).orderBy("qid", "place").collect():
        got[r.qid].append(r.option.lower())
    assert {k: sorted(v) for k, v in got.items()} == {0: ["abc", "def", "ghi", "own 1"], 1: ["abc", "def", "ghi"], 2: ["abc", "def", "ghi", "own 1"]}


def test_rebalance_spans_take_each_share_evenly():
    share = build.choice_shares(2, 20, 4.0, 4, 0.35)
    own = {2: 40, 5: 3000, 9: 1000, 20: 500}
    spans = build.rebalance_spans(own, "en", share, 42)
    used = collections.Counter()
    for has, low, high, target in spans:
        assert target <= has and high > low and low == used[has]
        used[has] = high
    by_target = collections.Counter()
    for _, low, high, target in spans:
        by_target[target] += high - low
    left = dict(own)
    for k in sorted(share, reverse=True):
        eligible = {h: n for h, n in left.items() if h >= k and n}
        want = min(int(share[k] * sum(own.values())), sum(eligible.values()))
        assert by_target[k] == want
        for has, low, high, target in spans:
            if target == k:
                assert abs((high - low) - want * eligible[has] / sum(eligible.values())) < 1 + 1e-9
                left[has] -= high - low
    assert all(used[h] <= n for h, n in own.items())


@pytest.mark.parametrize("group", ["a", None])
def test_rebalance_takes_rows_once(spark, group):
    rows = [(i, group, [f"c{j % (1 + i % 21)}" for j in range(25)]) for i in range(400)]
    df = spark.createDataFrame(rows, "idx long, lang string, choices array<string>")
    got = build.rebalance(df, "lang", 3).collect()
    assert len({r.idx for r in got}) == len(got) > 200
    for r in got:
        distinct = 1 + r.idx % 21
        assert len(r.kept) == r.target - 1 and len(r.kept) + len(r.ignored) == distinct
    assert build.rebalance(df.limit(0), "lang", 3).count() == 0


def test_draws_by_weight_equal_a_walk(spark):
    weights, seed = {3: 0.1, 5: 0.25, 8: 0.4, 12: 0.25}, 4
    got = spark.range(300).select("id", (F.col("id") % 14).cast("int").alias("n")).select("id", "n", build.weighted_counts(F.col("n"), F.col("id"), seed, weights=weights).alias("ks")).collect()
    for r in got:
        left, found = {k: w for k, w in weights.items() if k > r.n}, []
        for i in range(6):
            goal, upto = int(hashlib.md5(f"{seed}|{r.id}|{i}".encode()).hexdigest()[:8], 16) / 2**32 * sum(left.values()), 0.0
            for k, w in left.items():
                upto += w
                if goal < upto:
                    found += [k] * (k not in found)
                    break
        assert r.ks == found[:2]


def test_variants_carry_no_lines(spark):
    plan = catalog.QUERIES["emit_variants"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" in plan


def test_trivia_questions_are_dealt_before_they_meet(spark, monkeypatch):
    plans, save = {}, Workspace.save

    def seen(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return save(self, df, name)

    monkeypatch.setattr(Workspace, "save", seen)
    questions = spark.range(6000).selectExpr("id AS qid", "concat('answer ', id % 20 + 100) AS gold", "array('x') AS aliases").coalesce(1)
    assert build.trivia_options(questions, 1).count() == 18_000
    met = plans["round0"].index("Generate")
    assert "Exchange hashpartitioning(qid" in plans["round0"][met:] and "Exchange hashpartitioning(qid" not in plans["round0"][:met]


def test_questions_are_made_once(spark):
    grown = building.expand_options(spark, "/root/testdata/sf0.001")
    assert not any("lineitem" in f or "orders" in f for f in grown.inputFiles())  # before: joined for the pool, the asking and the result
