"""Stages of the corpus pipeline: brute force, nulls, repeats, ties and empty tables."""

import random
from collections import Counter

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = " ".join(f"the word{i} of and to in" for i in range(30))


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)


def linked(a, b, width=5, percent=80):
    x, y = ({tuple(w[j : j + width]) for j in range(len(w) - width + 1)} for w in (a.split(), b.split()))
    return 100 * len(x & y) >= percent * len(x | y)


def test_near_dedup_links_five_words_at_80_percent(spark):
    texts = {}
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(100)]
        texts[3 * g] = " ".join(base)
        texts[3 * g + 1] = " ".join(base + [f"g{g}own{i}" for i in range(14 + g)])  # a block of its own
        texts[3 * g + 2] = " ".join(f"g{g}x{i}" if i % 30 == 9 else w for i, w in enumerate(base))  # scattered edits
    assert linked(texts[24], texts[25]) and not linked(texts[24], texts[25], 3, 85) and not linked(texts[0], texts[2])
    root = {i: i for i in texts}
    for _ in range(3):
        for g in range(0, 36, 3):
            for a in range(g, g + 3):
                for b in range(g, g + 3):
                    if linked(texts[a], texts[b]):
                        root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, table(spark, texts), "").collect()}
    assert got == {i for i in root if root[i] == i} and 1 not in got and 34 in got


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, GOOD, "en", "a", 1), (1, GOOD, "en", "a", 1), (None, GOOD + " x", "en", "b", 1), (None, "une autre phrase " * 30, "fr", None, 2), (3, None, None, None, None)]
    rows += [(4, "", "en", "a", 0), (5, "12 34", "en", "a", 5), (6, "short but fine", "en", "a", 3), (2**62 + 1, " ".join(f"z{i} und der die" for i in range(40)), "de", "b", 9)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    assert df.columns == list(corpus_pipeline.COLUMNS)
    return Counter(map(tuple, df.collect()))


def test_language_id_keeps_rows_with_letters(spark, odd):
    expected = Counter(tuple(r) for r in odd.collect() if r.text and any(c.isalpha() for c in r.text))
    assert rows_of(corpus_pipeline.language_id(spark, odd, "", sure=2.0)) == expected  # no lang is null here
    told = rows_of(corpus_pipeline.language_id(spark, odd, ""))
    assert Counter((r[0], r[1]) for r in told.elements()) == Counter((r[0], r[1]) for r in expected.elements())


def test_predicted_language_decides_what_the_rules_keep(spark):
    words = {"en": "the of and to in is that it was for".split(), "de": "der die und das ist nicht ein von mit auf".split()}
    rng = random.Random(7)
    prose = lambda lang, i: " ".join(f"{rng.choice(words[lang])} {lang}{rng.randrange(50)}" for _ in range(120))
    rows = [(i, prose(lang, i), lang, "s", 1) for i in range(200) for lang in [("en", "de")[i % 2]]]
    wrong = [(1000, prose("de", 333), "en", "s", 1), (1001, prose("de", 335), None, "s", 1), (1002, "zz qq " * 40, None, "s", 1)]
    docs = spark.createDataFrame(rows + wrong, SCHEMA)
    told = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert told[1000] == told[1001] == "de" and told[1002] is not None and all(told[i] == ("en", "de")[i % 2] for i in range(200))
    kept = lambda df: {r.doc_id for r in corpus_pipeline.quality_rules(spark, df, "").collect()}
    with_model, without = kept(corpus_pipeline.language_id(spark, docs, "")), kept(docs)
    assert 1000 in with_model and 1000 not in without  # judged by its own language it stays


def test_rows_that_differ_in_nulls_are_two(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", None, 5), (1, "a b c", None, "en", 5), (1, "", None, "en", 5), (1, "", "en", None, 5)], SCHEMA)
    keys = [r["_key"] for r in corpus_pipeline.keyed_rows(docs).collect()]
    assert len(set(keys)) == 4
    taken = rows_of(corpus_pipeline.source_mix(spark, docs, ""))
    assert sum(taken.values()) >= 2 and all(n <= 2 for n in taken.values())
    kept = rows_of(corpus_pipeline.near_dedup(spark, docs, ""))
    assert (1, "", None, "en", 5) in kept and (1, "", "en", None, 5) in kept and len(kept) == 3


def test_hashes_that_clash_do_not_merge_rows(spark, odd, monkeypatch):
    whole = corpus_pipeline.row_hash
    expected = [rows_of(f(spark, odd, "")) for f in (corpus_pipeline.near_dedup, corpus_pipeline.quality_rules)][0]
    monkeypatch.setattr(corpus_pipeline, "row_hash", lambda seed: whole(seed) if seed == 2 else whole(seed).bitwiseAND(1))
    assert rows_of(corpus_pipeline.near_dedup(spark, odd, "")) == expected
    mixed = rows_of(corpus_pipeline.source_mix(spark, odd, ""))
    assert set(mixed) <= set(rows_of(odd)) and all(n <= 2 * rows_of(odd)[r] for r, n in mixed.items())


def test_quality_rules_judge_each_row(spark, odd):
    got = rows_of(corpus_pipeline.quality_rules(spark, odd, ""))
    assert {r[0] for r in got} <= {1, None, 2**62 + 1} and got[1, GOOD, "en", "a", 1] == 2
    assert not any(r[1] is None or len(r[1].split()) < 20 for r in got) and (2**62 + 1) in {r[0] for r in got}


def test_near_dedup_of_nulls_and_repeats(spark, odd):
    got = rows_of(corpus_pipeline.near_dedup(spark, odd, ""))
    assert all(n == 1 for n in got.values())
    # GOOD and its near copy are one class, kept under the id that is not null
    assert sum(r[1] is not None and r[1].startswith(GOOD) for r in got) == 1 and (1, GOOD, "en", "a", 1) in got
    assert (3, None, None, None, None) in got and (4, "", "en", "a", 0) in got and len(got) == 7


def test_source_mix_takes_rows_by_their_own(spark, odd):
    got, again = (rows_of(corpus_pipeline.source_mix(spark, df, "")) for df in (odd, odd.repartition(3)))
    given = rows_of(odd)
    assert got == again and all(n <= 2 * given[r] for r, n in got.items()) and set(got) <= set(given)
    assert not any(r[1] in (None, "") for r in got)


def test_byte_bpe_encodes_every_row(spark, odd):
    out = corpus_pipeline.byte_bpe(spark, odd, "").collect()
    assert len(out) == odd.count() and {len(r.ids) == r.n_tokens for r in out} == {True}
    assert {r.doc_id for r in out} == {r.doc_id for r in odd.collect()}


def test_stages_of_an_empty_table(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), "").count() == 0


def test_run_is_its_stages(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))
