"""Decontamination, vector codes and ranked search on small tables with nulls, ties and repeats, against SQL and brute force."""

import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomwork.llm import contamination, impact, oracles, terms, vafile
from loomwork.llm.minhash import _WordHash

DOCS = "doc_id long, text string, lang string, item_id string, row int, h string, n int, score long, query long"
ITEMS = "item_id long, text string, doc_id string, wid string, len int"
VECTORS = "vec_id long, embedding array<float>, label int, id string, v int, code string, row int"


def same(df, statement, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toArrow())
    columns = sorted(df.columns)
    ours = df.select(*columns).toPandas()
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({statement})").fetchall()
    canon = lambda rows: sorted(str(tuple(None if pd.isna(v) else int(v) if isinstance(v, (int, float, np.number)) else v for v in r)) for r in rows)
    assert canon(ours.itertuples(index=False, name=None)) == canon(theirs)
    return ours


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(40)] + ["é1", "你好", "A-b", "x y", "don't"]
    draw = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, draw(int(rng.integers(8, 40)))) for i in range(12)]
    items += [(20, "w1"), (21, "w1 w2 W3"), (22, None), (23, ""), (None, draw(12)), (24, items[0][1]), (24, draw(15)), (25, "same same same same same same same same same same same same"), (26, "!?")]
    docs = [(i, draw(int(rng.integers(0, 60)))) for i in range(60)]
    docs += [(100 + i, f"{draw(5)} {items[i][1].upper()} {draw(5)}") for i in range(12)]
    docs += [(200, items[3][1]), (200, items[3][1]), (200, items[4][1]), (None, items[5][1]), (201, None), (202, ""), (203, "same, " * 400), (204, "w1\x00w2\x7fw3")]
    docs += [(205, (draw(500) + " " + items[6][1] + "\n") * 12), (206, "a" * 100_000), (207, "same " * 9)]
    return (
        spark.createDataFrame([(i, t, "en", "x", 1, "h", 0, 7, 7) for i, t in docs], DOCS).repartition(3),
        spark.createDataFrame([(i, t, "x", "x", 1) for i, t in items], ITEMS),
    )


def test_decontamination_equals_sql(texts):
    docs, items = texts
    got = same(contamination.decontaminate(docs, items), oracles.OP11, documents=docs, benchmark=items)
    assert got.contaminated.sum() >= 20
    assert (got.n_hit[got.doc_id == 203] == 400).all() and (got.n_hit[got.doc_id == 207] == 0).all()


def test_decontamination_of_empty_tables(spark, texts):
    docs, items = texts
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert contamination.decontaminate(none[0], items).count() == 0
    same(contamination.decontaminate(docs, none[1]), oracles.OP11, documents=docs, benchmark=none[1])


def test_partial_containment_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    word = re.compile(r"[0-9a-z]+")
    items = [(i, " ".join(rng.choice([f"w{j}" for j in range(300)], 14))) for i in range(5)]
    docs = []
    for i in range(40):
        own = items[i % 5][1].split()
        for at in rng.choice(14, i % 4, replace=False):
            own[at] = "other"
        docs.append((i, " ".join(["pad"] * (i % 3) + own)))
    plan = contamination.WindowPlan(width=8, shingle=2, percent=60)
    got = {r.doc_id: (r.n_hit, r.n_items) for r in contamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), plan).collect()}
    grams = lambda w: [tuple(w[i : i + 2]) for i in range(len(w) - 1)]
    for i, text in docs:
        own, hit, of = word.findall(text), set(), set()
        for item, asked in items:
            asked = word.findall(asked)
            for a in range(len(asked) - 7):
                want = grams(asked[a : a + 8])
                for s in range(len(own) - 7):
                    if 100 * sum(x == y for x, y in zip(want, grams(own[s : s + 8]), strict=True)) >= 60 * len(want):
                        hit |= set(range(s, s + 8))
                        of.add(item)
        assert got[i] == (len(hit), len(of)), i


def test_hash_filter_passes_its_members_and_few_others(spark):
    members = np.random.default_rng(0).integers(-(1 << 63), 1 << 63 - 1, 500)
    found = terms.hash_filter(spark.createDataFrame([(int(h),) for h in members], "h long"), 500)
    assert found.passes(members.view(np.uint64)).all()
    assert found.passes(np.random.default_rng(1).integers(0, 1 << 63, 100_000, np.uint64)).mean() < 0.01
    assert not terms.hash_filter(spark.createDataFrame([], "h long"), 0).passes(members.view(np.uint64)).any()


def test_term_runs_hash_every_term_of_long_and_null_texts():
    import pyarrow as pa

    texts = [b"A b-c", None, b"", "é B".encode() * 2_000_000, b"x"]
    runs = list(terms.term_runs(pa.array(texts, pa.binary()), _WordHash()))
    assert [r[0] for r in runs] == [0, 4]
    assert runs[0][2].tolist() == [3, 3, 3, 3 + 2_000_001] and runs[1][2].tolist() == [1]
    assert runs[0][1][0] != runs[0][1][1]


@pytest.mark.parametrize("bits", [1, 2, 4, 6])
def test_va_file_finds_the_nearest_entry(bits):
    rng = np.random.default_rng(bits)
    for k, d, spread in ((1, 4, 50), (64, 4, 6), (64, 4, 500), (200, 3, 40), (7, 1, 2), (5, 2, 1)):
        entries, parts = rng.integers(-spread, spread + 1, (k, d)), rng.integers(-2 * spread, 2 * spread + 1, (500, d))
        apart = ((parts[:, None] - entries[None]) ** 2).sum(2)
        number, dist = vafile.VaFile(entries, bits).nearest(parts)
        assert (number == apart.argmin(1)).all() and (dist == apart.min(1)).all()
        lower, upper = vafile.VaFile(entries, bits).bounds(parts)
        assert (lower <= apart).all() and (apart <= upper).all()


def test_vector_codes_equal_sql(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 64)], int(i % 3) if i % 5 else None, "x", 0, "c", 1) for i in range(150)]
    rows += [(7, rows[7][1], 2, "x", 0, "c", 1), (7, rows[8][1], None, "x", 0, "c", 1), (None, rows[9][1], 1, "x", 0, "c", 1)]
    rows += [(300 + i, rows[3][1], 1, "x", 0, "c", 1) for i in range(100)]
    rows += [(400, None, 1, "x", 0, "c", 1), (401, [None] * 64, 1, "x", 0, "c", 1), (402, [float("nan")] * 64, 1, "x", 0, "c", 1), (403, [float("inf")] + [0.0] * 63, 1, "x", 0, "c", 1), (404, [0.0] * 64, 9, "x", 0, "c", 1)]
    for n in (len(rows), 20):  # 20: fewer rows than entries
        table = spark.createDataFrame(rows[:n], VECTORS).repartition(3)
        got = same(vafile.vector_codes(table), oracles.OP12, embeddings=table)
        assert len(got) == n - 4 * (n > 20) and (got.code.str.len() == 32).all()


def test_vector_codes_of_odd_tables(spark):
    assert vafile.vector_codes(spark.createDataFrame([], VECTORS)).count() == 0
    odd = [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1), (3, [], 1), (4, [1e30] * 16, 1), (5, [-0.001] * 16, None)]
    got = vafile.vector_codes(spark.createDataFrame(odd, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == [(1, "00" * 16, 0), (5, "01" * 16, 0)]
    digest = hashlib.sha256(",".join(["256,-1"] * 16).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in got} == {digest}
    with pytest.raises(ValueError, match="equal parts"):
        vafile.vector_codes(spark.createDataFrame([(1, [1.0] * 17, 1)], "vec_id long, embedding array<double>, label int"))


def test_search_equals_sql(texts):
    docs, items = texts
    got = same(impact.search(docs, items), oracles.OP13, documents=docs, benchmark=items)
    assert len(got) > 100
    # many shards, levels and blocks of queries
    same(impact.search(docs, items, impact.SearchPlan(shard=64, block=40, step=0.99)), oracles.OP13, documents=docs, benchmark=items)


def test_search_of_empty_tables(spark, texts):
    docs, items = texts
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert impact.search(none[0], items).count() == 0
    assert impact.search(docs, none[1]).count() == 0


def test_scan_stops_early_and_stays_exact():
    rng = np.random.default_rng(6)
    n, t = 4000, 12
    doc, term = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(t), indexing="ij"))
    kept = rng.random(n * t) < 0.4
    doc, term = doc[kept], term[kept]
    score = (rng.pareto(1.2, len(doc)) * 100).astype(np.int64) + 1
    shard = impact.Shard(doc, term, score, n, t)
    asked = np.array([1, 4, 5, 9])
    whole = np.bincount(doc, np.where(np.isin(term, asked), score, 0), n).astype(np.int64)
    want = np.sort(whole)[::-1][:10]
    completed = []
    complete = shard._complete
    shard._complete = lambda docs, terms: completed.append(len(docs)) or complete(docs, terms)
    docs, found = shard.top(asked, 10, 0.8, 0)
    assert (found == whole[docs]).all() and (np.sort(found)[::-1][:10] == want).all()
    assert completed and completed[0] < n // 4
    docs, found = shard.top(asked, 10, 0.8, int(want[4]))
    assert (np.sort(found)[::-1][:5] == want[:5]).all()
    docs, found = shard.top(asked, 10, 0.8, int(want[0]) + 1)
    assert (found == whole[docs]).all() and len(docs) < n // 4
