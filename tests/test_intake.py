"""Numbered files, the ledger, isolated sources, gates, percentiles, scored files and assembly on small inputs."""

import json
import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomwork.functions import answers
from loomwork.functions.tokens import Counter as Counter_
from loomwork.functions.tokens import token_count
from loomwork.operators import assembly, gates, quantiles, rows, scoring
from loomwork.sources import files, loaders
from loomwork.streaming.ledger import Ledger, Rules, stream_into


@pytest.fixture
def small_splits(spark):
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "16k")
    yield
    spark.conf.set(setting, before)


def test_lines_of_many_splits_are_numbered_as_a_plain_count(spark, tmp_path, small_splits):
    rng = random.Random(1)
    expected, row = {}, 0
    (tmp_path / "in").mkdir()
    for name, n in (("a.jsonl", 6000), ("b.jsonl", 1), ("c.jsonl", 0), ("d.jsonl", 900)):
        lines = [rng.choice(["", "  ", "\t"]) if rng.random() < 0.1 else json.dumps({"a": f"{name}{i}" + "é" * rng.randrange(60)}) for i in range(n)]
        (tmp_path / "in" / name).write_bytes(("\r\n" if name == "d.jsonl" else "\n").join(lines).encode())
        for i, line in enumerate(lines):
            if line.strip():
                row += 1
                expected[json.loads(line)["a"]] = (name, i + 1, row)
    numbered = files.jsonl_numbered(spark, f"{tmp_path}/in", "a string")
    got = {r.a: (r.file.rsplit("/", 1)[1], r.line_no, r.row_no) for r in numbered.collect()}
    assert got == expected
    assert spark.read.text(f"{tmp_path}/in/a.jsonl").rdd.getNumPartitions() > 10  # one file, many tasks


def test_zipped_files_must_be_as_long(spark, tmp_path, small_splits):
    (tmp_path / "l").write_text("\n".join(json.dumps({"a": i}) for i in range(5000)))
    (tmp_path / "r").write_text("\n\n".join(json.dumps({"b": -i}) for i in range(5000)))
    (tmp_path / "s").write_text("\n".join(json.dumps({"b": -i}) for i in range(4999)))
    left, right, short = (files.jsonl_numbered(spark, f"{tmp_path}/{n}", f"{c} long") for n, c in (("l", "a"), ("r", "b"), ("s", "b")))
    got = files.zipped(left, right).collect()
    assert len(got) == 5000 and all(r.a == -r.b == r.row_no - 1 for r in got)
    with pytest.raises(Exception, match="differ in length"):
        files.zipped(left, short).collect()


def rules():
    return Rules("k", ("v",), F.when(F.col("v") < 0, "negative"))


def held(ledger, kind="accepted"):
    df = ledger.read(kind)
    return [] if df is None else sorted((r.k, r.v) for r in df.collect())


class Killed(Exception):
    pass


def killed():
    raise Killed


def test_a_batch_that_dies_before_it_is_published_comes_once(spark, tmp_path):
    batch = lambda *r: spark.createDataFrame(list(r), "k long, v long")
    ledger = Ledger(spark, str(tmp_path / "sink"))
    assert ledger.read() is None
    with pytest.raises(Killed):
        ledger.append(batch((1, 10), (2, -1)), 0, rules(), before_publish=killed)
    assert ledger.read() is None and len(list((tmp_path / "sink/batches").iterdir())) == 1
    assert Ledger(spark, str(tmp_path / "sink")).append(batch((1, 10), (2, -1)), 0, rules())
    assert held(ledger) == [(1, 10)] and held(ledger, "rejected") == [(2, -1)]
    assert len(list((tmp_path / "sink/batches").iterdir())) == 1  # what the dead writer left is gone
    assert not ledger.append(batch((1, 10), (9, 9)), 0, rules()) and held(ledger) == [(1, 10)]
    # repeats within a batch and of an earlier one, rejected keys and a null key
    assert ledger.append(batch((3, 8), (3, 7), (1, 99), (2, 5), (None, 4), (None, 4)), 1, rules())
    assert held(ledger) == [(1, 10), (3, 7)]
    assert [(r.k, r.reject_reason) for r in ledger.read("rejected").where("batch = 1").collect()] == [(None, "no key")] * 2
    ledger.compact()
    assert held(ledger) == [(1, 10), (3, 7)] and len(ledger.entries()) == 1
    assert not ledger.append(batch((50, 1)), 1, rules())
    assert ledger.append(batch((3, 1), (4, 1)), 2, rules()) and held(ledger) == [(1, 10), (3, 7), (4, 1)]
    ledger.compact()
    assert held(ledger) == [(1, 10), (3, 7), (4, 1)] and {r.batch for r in ledger.read().collect()} == {0, 1, 2}


def test_a_killed_stream_goes_on_where_it_was(spark, tmp_path):
    spark.range(200).selectExpr("id % 150 AS k", "id - 20 AS v").repartition(6).write.parquet(str(tmp_path / "in"))
    sink = Ledger(spark, str(tmp_path / "sink"))
    stream = lambda: spark.readStream.schema("k long, v long").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    tries = iter(range(10))
    die_second = lambda: killed() if next(tries) == 1 else None
    query = stream_into(stream(), sink, rules(), str(tmp_path / "check"), die_second)
    with pytest.raises(Exception):  # noqa: B017
        query.awaitTermination()
    assert len(sink.entries()) == 1
    for _ in range(2):
        stream_into(stream(), sink, rules(), str(tmp_path / "check")).awaitTermination()
    got = held(sink) + held(sink, "rejected")
    assert sorted(k for k, _ in got) == list(range(150)) and len(sink.entries()) == 3


def test_rows_that_fail_alone_are_quarantined(spark, tmp_path):
    raw = spark.range(1000).selectExpr("id AS k", "cast(id AS string) AS t").repartition(5)
    load = lambda bad: lambda df: (df.where(F.assert_true(~F.col("k").isin(bad), "bad row").isNull()).select("k"), df)
    found = loaders.load_isolated({"a": raw, "b": raw, "c": raw}, {"a": load([-1]), "b": load([5, 777]), "c": load(list(range(0, 1000, 3)))}, most=10)
    per = Counter(r.source_ord for r in found.examples.collect())
    assert per == {0: 1000, 1: 998} and set(found.failed) == {"c"}
    bad = found.quarantine.collect()
    assert {(r.source, json.loads(r.row)["k"]) for r in bad} == {("b", 5), ("b", 777)} and all("bad row" in r.reason for r in bad)


def test_a_file_that_breaks_off_keeps_what_was_read(spark, tmp_path):
    spark.range(500).repartition(4).write.parquet(str(tmp_path / "p"))
    broken = sorted((tmp_path / "p").glob("*.parquet"))[0]
    lost = spark.read.parquet(str(broken)).count()
    broken.write_bytes(broken.read_bytes()[:60])
    for crc in (tmp_path / "p").glob(".*.crc"):
        crc.unlink()
    raw = spark.read.schema("id long").parquet(str(tmp_path / "p"))
    found = loaders.load_isolated({"a": raw}, {"a": lambda df: (df.select("id"), df)})
    assert found.examples.count() == 500 - lost > 0 and not found.failed


@pytest.mark.parametrize("parts", [2, 7, 64])
def test_percentiles_equal_numpy(spark, parts):
    rng = np.random.default_rng(parts)
    data = {"a": rng.integers(-500, 500, 301), "b": np.full(50, 7), None: rng.integers(0, 10**12, 20), "one": np.array([3]), "two": np.array([-(2**40), 2**40])}
    table = spark.createDataFrame([(g, int(v)) for g, own in data.items() for v in own] + [("a", None), ("none", None)], "g string, v long").repartition(3)
    wanted = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in quantiles.percentiles(table, "g", "v", wanted).collect()}
    assert set(got) == set(data)
    for g, own in data.items():
        assert (got[g].n, got[g].low, got[g].high) == (len(own), own.min(), own.max())
        assert [got[g][n] for n in wanted] == pytest.approx(list(np.quantile(own.astype(float), list(wanted.values()))), rel=1e-12, abs=1e-6)
    at = {r.g: r for r in quantiles.at_places(table, "g", "v", {"mid": F.floor(F.col("n") / 2), "far": F.col("n") + 5}, parts).collect()}
    for g, own in data.items():
        assert (at[g].mid, at[g].far) == (sorted(own)[len(own) // 2], own.max())
    assert quantiles.percentiles(table.limit(0), "g", "v", wanted).count() == 0


@pytest.mark.parametrize(("limit", "budget"), [(None, None), (10, None), (None, 700), (10, 700), (10**6, 10**6), (None, 0)])
def test_token_gate_equals_a_loop(spark, limit, budget):
    rng = random.Random(9)
    sizes = [rng.randrange(1, 120) for _ in range(200)]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "id long, n long, place_ string").repartition(4)
    kept, report = gates.token_gate(df, F.col("n"), [F.col("id")], 100, limit, budget)
    want, total, scanned, overlong = [], 0, 0, 0
    for i, n in enumerate(sizes):
        scanned += 1
        if n > 100:
            overlong += 1
            continue
        if budget is not None and total + n > budget:
            break
        total += n
        want.append((i, n, len(want) + 1, total))
        if limit is not None and len(want) >= limit:
            break
    assert sorted((r.id, r.tokens, r.place, r.upto) for r in kept.collect()) == want
    got = report.collect()[0]
    assert (got.kept, got.tokens, got.scanned, got.overlong) == (len(want), total, scanned, overlong)


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    texts = ["a b c", "", None, "é你好 <|endoftext|> x", "word " * 3000] + [f"text {i}" for i in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.n for r in df.select("i", token_count(F.col("t"), Path(path).read_text()).alias("n")).collect()}
    assert got == {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def items(spark, *rows_):
    return spark.createDataFrame(list(rows_), "index long, prompt string, reference string, answer string, completions array<string>")


def test_scored_file_details_and_errors(spark):
    good = items(spark, (0, "p", "4", "5", ["\\boxed{4}", "\\boxed{5}", "none"]), (1, "q", None, "7", ["x", "\\boxed{7}", "\\boxed{7}"]))
    details, metrics = scoring.score_file(good, "boxed")
    got = {r["index"]: r for r in details.collect()}
    assert (got[0].reference, got[0].n, got[0].c) == ("4", 3, 1) and (got[1].reference, got[1].c) == ("7", 2)
    assert [(x.extracted, x.correct) for x in got[0].completions] == [("4", True), ("5", False), (None, False)]
    m = metrics.collect()[0]
    assert (m.n_problems, m.n_completions, m.pass_8) == (2, 3, None) and m.pass_1 == pytest.approx(0.5)
    eight = items(spark, (0, "p", "4", None, ["\\boxed{4}"] + ["no"] * 7))
    assert scoring.score_file(eight, "boxed")[1].collect()[0].pass_8 == 1.0
    row = (0, "p", "4", None, ["a"])
    for bad, why in ([(1, "p", None, None, ["a"])], "neither"), ([(1, "p", "4", None, [])], "no completions"), ([(1, "p", "4", None, None)], "no completions"), ([(1, "p", "4", None, ["a", "b"])], "different"):
        with pytest.raises(Exception, match=why):
            scoring.score_file(items(spark, row, *bad), "boxed")[0].collect()
    with pytest.raises(Exception, match="empty"):
        scoring.score_file(items(spark, row).limit(0), "boxed")[1].collect()


def test_assembly_routes(spark):
    user = [{"role": "user", "content": "Q?"}, {"role": "assistant", "content": "old"}]
    system = [{"role": "system", "content": "S"}, {"role": "assistant", "content": "old"}]
    given = [("a", user), ("b", user), ("c", system), ("d", user), ("", user), (None, user), ("e", user)]
    given = spark.createDataFrame([(u, m, "src", "B") for u, m in given], "uid string, messages array<struct<role:string,content:string>>, cot_source string, gold_letter string")
    right = "long reasoning here</think>\nThe answer is \\boxed{B}"
    samples = [("a", 0, "wrong</think>\\boxed{C}", "b"), ("a", 1, right, " b "), ("a", 2, "short</think>\\boxed{B}", "B"), ("b", 0, "x</think>\\boxed{C}", "B"), ("c", 0, right, "B"), ("e", 0, "cut off", "B")]
    samples = spark.createDataFrame(samples, "uid string, attempt long, completion string, gold string")
    run = lambda **kw: assembly.assemble(given, samples, "new", **kw)
    out, log = run()
    got = {r.uid: r for r in out.collect()}
    assert {u: r.route for u, r in got.items()} == {"a": "replaced", "b": "fallback", "c": "dropped", "d": "skipped", "": "skipped", None: "skipped", "e": "fallback"}
    assert got["a"].cot_source == "new" and got["a"].messages[1].content == "<think>\nlong reasoning here\n</think>\n\nThe answer is \\boxed{B}"
    assert [m.role for m in got["a"].messages] == ["user", "assistant"] and got["b"].messages[1].content == "old"
    assert sorted((r.uid, r.gold_letter, r.n_samples) for r in log.collect()) == [("b", "B", 1), ("e", "B", 1)]
    report = assembly.assembly_report(out).collect()[0]
    assert (report.in_scope, report.replaced, report.fallback, report.dropped, report.passthrough, report.kept) == (4, 1, 2, 1, 0, 3)
    assert (report.kept_pct, report.replaced_pct) == (75.0, 25.0)
    best = {r.uid: r for r in run(shortest=True, keep_raw=True, filtered=True, fallback=False)[0].collect()}
    assert "short" in best["a"].messages[1].content and best["a"].raw_completion == "short</think>\\boxed{B}"
    assert best["d"].route == "passthrough" and best["b"].route == "dropped"


def test_trivia_records(spark):
    answers = [("Rome", ["the eternal city"]), ("Rome Italy", []), ("In Rome", []), ("Paris", ["rome"]), ("Oslo", []), ("Bern", []), ("Cairo", []), ("Lima", []), ("N/A", []), ("?", []), ("", []), (None, None)]
    raw = spark.createDataFrame([(i, f" q{i} ", {"value": v, "aliases": a}) for i, (v, a) in enumerate(answers)] + [(50, " ", {"value": "Quito", "aliases": []})], "question_id long, question string, answer struct<value:string,aliases:array<string>>")
    good, bad = loaders.triviaqa(raw)
    got = {r.question: r for r in good.collect()}
    assert set(got) == {f"q{i}" for i in range(8)} and {r.question_id for r in bad.collect()} == {8, 9, 10, 11, 50}
    for i, (gold, aliases) in enumerate(answers[:8]):
        r = got[f"q{i}"]
        assert r.options[r.gold_idx] == gold and len(set(r.options)) == 4
        others = [o.lower() for o in r.options if o != gold]
        assert not any(o in gold.lower() or gold.lower() in o or o in aliases for o in others)
    few, rest = loaders.triviaqa(raw.where("question_id < 4"))
    assert few.count() == 0 and rest.count() == 4 and "triviaqa" in loaders.REGISTRY


def test_exact_strata_and_shares(spark):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(["a"] * 33 + ["b"] * 33 + ["c"] * 33 + [None] * 4)], "id long, g string")
    got = Counter((r.g, r.split) for r in rows.stratified(df, "g", 1, "id", 0.1).collect())
    assert sum(n for (_, s), n in got.items() if s == "test") == math.ceil(10.3) and all(got[g, "test"] in (3, 4) for g in "abc")
    share = rows.equal_share(df.where("g IS NOT NULL"), "g", [F.col("id")], 30).collect()
    assert Counter(r.g for r in share) == dict.fromkeys("abc", 10)
    with pytest.raises(Exception, match="fewer than"):
        rows.equal_share(df, "g", [F.col("id")], 40).collect()


def test_batches_differ_by_epoch(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i < 90 else None) for i in range(100)], "id long, g string")
    epochs = [sorted((r.place, r.g or "", r.batch, r.id) for r in rows.group_batches(df, "g", "id", 8, 3, e).collect()) for e in (0, 0, 1)]
    assert epochs[0] == epochs[1] != epochs[2]
    assert len(epochs[0]) == 88 and Counter(p for p, *_ in epochs[0]) == dict.fromkeys(range(1, 12), 8)
    assert all(len({g for q, g, *_ in epochs[0] if q == p}) == 1 for p in range(1, 12))


def test_recipe_takes_each_key_once(spark):
    pool = lambda *r: spark.createDataFrame(list(r), "uid string, lang string, doc_id long")
    block = spark.createDataFrame([("x",)], "uid string")
    one = pool(("a", "en", 1), ("a", "en", 0), ("x", "en", 2), ("b", "de", 3), ("c", "en", 4))
    two = pool(("a", "en", 10), ("d", "en", 11), ("c", "de", 12))
    got = sorted((r.part, r.uid, r.doc_id) for r in rows.recipe([("p", one, 2), ("q", two, 9)], "uid", "lang", block, 1, "doc_id").collect())
    assert [g for g in got if g[0] == "q"] == [("q", "d", 11)]
    assert len(got) == 3 and ("p", "b", 3) in got and got[0][1:] in (("a", 0), ("b", 3))


def test_equal_pieces_are_counted_once():
    from tokenizers import Tokenizer

    definition = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    library, counter = Tokenizer.from_str(definition), Counter_(definition)
    library.encode_special_tokens = True
    parts = ["", " ", "  ", "\n", "\x1c", "\x85", "　", "᠎", "​", "é", "é", "don't", "'s", "_x", "12", "½", "<|endoftext|>", "你好", "😀", "a" * 90]
    texts = [a + s + b + " " + a for a in parts for b in parts for s in ("", " ", "  ", " \n ")]
    assert counter.cuts and counter(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    asked, ask = [], counter._ask
    counter._ask = lambda pieces: asked.extend(pieces) or ask(pieces)
    counter([" one two"] * 50 + [" two one"])
    assert sorted(asked) == ["", " one", " two"] or sorted(asked) == [" one", " two"]  # before: every text whole


def test_a_file_is_graded_once(spark):
    details, metrics = scoring.score_file(items(spark, (0, "p", "4", "5", ["\\boxed{4}", "none"])), "boxed")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (details, metrics)]
    assert not any("regexp" in p for p in plans) and metrics.collect()[0].pass_1 == 0.5  # before: graded for each


def test_equal_answers_are_graded_once(spark, monkeypatch):
    written, save = {}, scoring.Workspace.save
    monkeypatch.setattr(scoring.Workspace, "save", lambda self, df, name: written.setdefault(name, save(self, df, name)))
    rows_ = [(i, f"p{i}", "4", None, ["\\boxed{4.0}", "so \\boxed{4.0}", "\\boxed{5}", "none", None]) for i in range(30)]
    rows_.append((30, "q", "5.0", None, ["\\boxed{5}", "\\boxed{x=5}", "\\boxed{4.0}", "\\fbox{5} \\boxed{5", "\\boxed{{5.0}}"]))
    details, metrics = scoring.score_file(items(spark, *rows_), "boxed")
    asked = sorted((r._x, r._r, r.correct) for r in written["graded"].collect())  # before: 91 answers graded row by row
    assert asked == [("4.0", "4", True), ("4.0", "5.0", False), ("5", "4", False), ("5", "5.0", True), ("5.0", "5.0", True), ("x=5", "5.0", True)]
    got = {r["index"]: r for r in details.collect()}
    assert all(got[i].c == 2 and [x.correct for x in got[i].completions] == [True, True, False, False, False] for i in range(30))
    assert got[30].c == 3 and [(x.extracted, x.correct) for x in got[30].completions] == [("5", True), ("x=5", True), ("4.0", False), (None, False), ("5.0", True)]
    assert metrics.collect()[0].n_problems == 31


def test_normal_forms_are_made_once(spark):
    df = spark.createDataFrame([("x=5", "5.0", True), ("\\frac12", "0.5", True), (None, "5", False), ("6", "5", False)], "x string, r string, want boolean")
    right = df.select("want", answers.correct(F.col("x"), F.col("r"), "boxed").alias("got"))
    assert all(r.want == r.got for r in right.collect())
    assert right._jdf.queryExecution().optimizedPlan().toString().count("finalansweris") <= 6  # three of each side; before: 14, some made again and again


def test_boxes_nested_and_open(spark):
    texts = {"\\boxed{a}": "a", "\\boxed{a{b}c} d}": "a{b}c", "\\boxed{{{a}}}": "{{a}}", "\\boxed{}": "", "\\boxed{a": None, "\\boxed{a{b}": None, "\\boxed a}": None, "\\fbox{é{😀}}}": "é{😀}", "\\boxed": None, "a}": None}
    got = {r.t: r.b for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", answers.boxed(F.col("t")).alias("b")).collect()}
    assert got == texts
