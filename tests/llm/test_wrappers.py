"""Every registered corpus query on small tables, against brute force or SQL."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import files, langid, minhash, oracles, queries, sharding, tokenbin, warc
from loomwork import workspace
from loomwork.workspace import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rng = np.random.default_rng(3)
    vocab = {"en": "the cat sat on a mat and saw two dogs run away".split(), "de": "der hund lief über die straße und sah zwei katzen".split()}
    rows = []
    for i in range(400):
        lang = "en" if i % 3 else "de"
        text = " ".join(rng.choice(vocab[lang], int(rng.integers(1, 60))))
        rows.append((i, text, lang, f"s{i % 5}" if i % 5 else None, len(text)))
    rows += [(1000 + i, rows[7][1], "en", "hot", 1) for i in range(150)]
    rows += [(None, "the cat", "en", "s1", 1), (None, "the cat", "en", "s1", 1), (2000, None, "en", None, None), (2001, "", "de", "s2", 0), (2002, "123 ... 你好 <|endoftext|> x", None, "s2", 9)]
    rows += [(2003, "Ünïcode ½ ﬁ é" * 2000, "xx", "s3", 1), (-(2**63), "low id", "en", "s4", 1), (2004, "a" * 70_000, "en", "s4", 1)]
    write(spark, path, "documents", rows, SCHEMA)
    return str(path), rows


def test_op3_equals_brute_force(spark, sf):
    path, rows = sf
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    counts = {}
    for i, text, lang, *_ in rows:
        if text is not None and lang is not None and not held(i):
            counts.setdefault(lang, Counter()).update(langid._LETTERS.findall(text.lower()))
    langs = sorted(counts)
    tables = [{} for _ in range(6)]
    for lang in langs:
        for w, n in counts[lang].items():
            for k in range(6):
                for g in langid.grams_of(w, k) if k else [w]:
                    tables[k].setdefault(g, Counter())[lang] += n
    totals = [{lang: sum(c[lang] for c in t.values()) for lang in langs} for t in tables]
    cell = lambda k, g, lang: math.log(0.99 * tables[k][g][lang] / max(totals[k][lang], 1) + 0.01 / len(tables[k]))

    def score(w, lang):
        if w in tables[0]:
            return cell(0, w, lang)
        for k in range(5, 0, -1):
            if known := [g for g in langid.grams_of(w, k) if g in tables[k]]:
                return sum(cell(k, g, lang) for g in known) / len(known)
        return 0.0

    got = queries.op3_language_id(spark, path).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in rows:
        own = langid._LETTERS.findall((text or "").lower())
        r = by[i][0]
        assert r.held_out == held(i)
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        mean = [sum(score(w, lang) for w in own) / len(own) for lang in langs]
        best = max(mean)
        share = 1 / sum(math.exp(m - best) for m in mean)
        assert r.score == pytest.approx(share, rel=1e-4)
        assert mean[langs.index(r.lang_pred)] == pytest.approx(best, abs=1e-4)


def test_op3_has_no_cap_on_languages(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x " * 3, f"l{i:04d}") for i in range(1100)]
    docs = spark.createDataFrame([(i, re.sub(r"\d", "", t), lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 1090


def test_op4_gives_the_librarys_ids(spark, sf):
    from tokenizers import Tokenizer

    path, rows = sf
    library = Tokenizer.from_str(queries.vocabulary("word_bpe_49k.json").decode())
    expected = {}
    for i, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    got = sorted(queries.op4_token_shards(spark, path).collect(), key=lambda r: r.start)
    assert 49407 in library.encode("x <|endoftext|> y", add_special_tokens=False).ids
    start, order = 0, [r.doc_id for r in got]
    assert order[:3] == [None, None, -(2**63)] and order[2:] == sorted(order[2:])
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in expected[r.doc_id]
        start += r.n_tokens
    assert len(got) == len(rows)


def test_op5_equals_tiktoken(spark, sf):
    import public_tokenizers
    import tiktoken

    from loomwork.llm import bpe

    path, rows = sf
    ranks = bpe.load_ranks(queries.vocabulary("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for i, text, *_ in rows:
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        expected[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, queries.op5_byte_bpe(spark, path).collect())) == expected


def test_op2_archives_always_hold_a_dictionary(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    few = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    for df in (pages, few):
        manifest = warc.write_archives(df, Workspace(spark, "t")).collect()
        assert sum(r.records for r in manifest) == df.count()
        for r in manifest:
            data = bytes(r.data)
            magic, n = struct.unpack_from("<II", data)
            assert magic == warc.SKIPPABLE and n > 0 and len(list(warc.records_of(data))) == r.records
    same = [(i, f"u{i}", "hot" if i % 3 else f"page {i % 40}") for i in range(900)]
    write(spark, tmp_path, "pages", same, "page_id long, url string, html string")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = queries.op2_warc_dictionary(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracles.OP2})").fetchall()))


def test_archives_and_shards_are_put_out_as_files(spark, sf, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    archives = warc.write_archives(pages, Workspace(spark, "t"), archive_bytes=1 << 16)
    told = files.put_out(archives, f"file://{tmp_path}/warc").collect()
    assert len(told) > 1 and sum(len(list(warc.records_of((tmp_path / "warc" / r.name).read_bytes()))) for r in told) == pages.count()
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet").select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text")
    file = queries.vocabulary("word_bpe_49k.json")
    shards, bases, dictionary = tokenbin.write_token_shards(docs, lambda width: tokenbin.worker_encoder(file, width), 1, 49_408, Workspace(spark, "t"), shard_bytes=1 << 14)
    told = files.put_out(shards, f"file://{tmp_path}/ids").collect()
    assert len(told) > 1 and bases.count() == len(told)
    found = 0
    for r in told:
        with (tmp_path / "ids" / r.name).open("rb") as f:
            shard = tokenbin.ShardReader(f, dictionary)
            found += sum(shard[i][2][-1] == 1 for i in range(shard.n))
    assert found == docs.count()
    with pytest.raises(ValueError, match="scheme"):
        files._folder("/data")


def test_side_files_lie_where_only_spark_reads(spark, sf, tmp_path, monkeypatch):
    """A checkpoint folder in a file system of Spark's alone: no worker opens a path by itself."""
    conf = spark._jsc.hadoopConfiguration()
    (tmp_path / "far").mkdir()
    conf.set("fs.viewfs.mounttable.away.link./far", f"file://{tmp_path}/far")
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(40)
    run = lambda: [
        sorted(map(str, df.collect()))
        for df in (warc.warc_archive(pages), tokenbin.word_token_file(docs, queries.vocabulary("word_bpe_49k.json")), langid.predict(docs, langid.fit(docs)))
    ]
    near = run()
    monkeypatch.setattr(workspace, "shared_root", lambda spark: "viewfs://away/far")
    assert run() == near and any((tmp_path / "far").iterdir())


def test_byte_bpe_of_another_pattern_joins_words(spark):
    import tiktoken
    from loomwork.llm import bpe

    ranks_file = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    pattern = r"\p{L}+ \p{L}+|\s|\S+"
    library = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.load_ranks(ranks_file), special_tokens={})
    texts = ["two words joined by a space here", " the of and to", "x", "", "one\ntwo three  four"]
    got = bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ranks_file, pattern, keep_ids=True)
    assert {r.doc_id: r.ids for r in got.collect()} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_op6_equals_sql(spark, tmp_path):
    hard = "<|im_end|>\n<|im_start|>user\\n </s>[INST] \\ <<SYS>> é"
    rows = [(c, t, ("system", "user", "assistant")[(c + t) % 3], f"{hard} {c} {t}" if (c + t) % 4 else None) for c in range(40) for t in range(1 + c % 9)]
    rows += [(77, t, "assistant" if t % 2 else "user", "long " * 50) for t in range(300)]
    write(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = queries.op6_chat_reply_trees(spark, str(tmp_path))
    theirs = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracles.OP6})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(theirs) and -7 in {r[0] for r in theirs}


def test_op6_pieces_make_whole_conversations(spark):
    from loomwork.llm import chat

    rows = [(i, 5, "assistant" if i % 2 else "user", f"text {i} </s>") for i in range(50)]
    messages = spark.createDataFrame(rows, "id long, conv_id long, role string, text string")
    paths = spark.range(50).selectExpr("49L AS path", "id + 1 AS place", "id")
    whole = chat.format_paths(paths, messages)
    pieces = chat.format_paths(paths, messages, piece_chars=100)
    assert whole.count() == 1 and pieces.count() > 5
    one, two = whole.first(), chat.whole_conversations(pieces).first()
    assert (one.text, one.starts, one.ends, one.conv_id) == (two.text, two.starts, two.ends, two.conv_id)


def test_op7_ids_with_two_texts_join_their_classes(spark, sf, tmp_path):
    a, b = ("one two three four five six", "seven eight nine ten eleven twelve")
    big = 2**62 + 1
    rows = [(1, a), (2, b), (5, a), (5, b), (9, "other words here now"), (big, a), (None, a), (9, None)]
    write(spark, tmp_path, "documents", rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in queries.op7_minhash_neardup(spark, str(tmp_path)).collect())
    assert got == Counter({(1, 1, True): 1, (2, 1, False): 1, (5, 1, False): 2, (9, 9, True): 2, (big, 1, False): 1, (None, None, True): 1})
    path, _ = sf
    spark.read.parquet(f"{path}/documents.parquet").where("doc_id IS NOT NULL").write.parquet(f"{tmp_path}/whole.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/whole.parquet/*.parquet')")
    ours = minhash.near_duplicates(spark.read.parquet(f"{tmp_path}/whole.parquet"))
    theirs = con.execute(f"SELECT {', '.join(ours.columns)} FROM ({oracles.OP7})").fetchall()
    assert sorted(map(tuple, ours.collect())) == sorted(theirs)


def test_op8_far_from_the_origin(spark, tmp_path):
    x = (np.random.default_rng(5).normal(size=(2000, 32)) + 1000).astype(np.float32)
    write(spark, tmp_path, "embeddings", [(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    found = {}
    for r in queries.op8_graph_ann(spark, str(tmp_path)).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q, own in found.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        hit += len({v for _, v, _ in own} & {i for i in np.lexsort((np.arange(len(x)), d)) if i != q} & set([i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]))
        assert all(s == pytest.approx(d[v], rel=1e-12) for _, v, s in own) and [k for k, *_ in sorted(own)] == list(range(1, 11))
    assert len(found) == 20 and hit >= 0.95 * 200


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
        open_ -= over
        if not open_:
            return out


def test_op9_targets_and_repeated_rows(spark, sf, tmp_path):
    path, rows = sf
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(words(text))
    goal = targets(sizes)
    got = queries.op9_pivotal_mix(spark, path).collect()
    assert len(got) == len(rows)
    taken, largest = Counter(), Counter()
    source = {}
    for i, text, _, s, _ in rows:
        source.setdefault((i, len(words(text))), s)
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s]) and r.taken <= 2 * r["size"]
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in goal)
    assert sorted(map(str, got)) == sorted(map(str, queries.op9_pivotal_mix(spark, path).collect()))
    write(spark, tmp_path, "documents", [(1, "w " * 10, "en", "s", 1)] * 1000, SCHEMA)
    same = queries.op9_pivotal_mix(spark, str(tmp_path)).collect()
    assert len(same) == 1000 and abs(sum(r.taken for r in same) - 15_000) <= 10


def test_op10_columns_and_parts(spark, sf):
    path, rows = sf
    got = queries.op10_histogram_shards(spark, path).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and {r.shard for r in got} <= set(range(24))
    clash = spark.range(100).selectExpr("id AS k", "1L AS size", "id AS shard", "'x' AS `_k`", "id AS `_key`", "2 AS `Slot`", "'d' AS `a.b`")
    out = sharding.histogram_shards(clash, "k", "size", 4)
    assert out.columns == ["k", "size", "_k", "_key", "a.b", "shard", "slot"] and Counter(r.shard for r in out.collect()) == {0: 25, 1: 25, 2: 25, 3: 25}


def test_op10_thousands_of_parts(spark):
    rows = spark.range(30_000).select((F.col("id") * 7919 % 30_011).alias("k"), F.lit(100).alias("size"))
    got = sharding.histogram_shards(rows, "k", "size", 24, part_bytes=500).collect()  # 6000 parts
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert len(by) == 24 and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 4
    keys = [r.k for s in sorted(by) for r in sorted(by[s], key=lambda r: r.slot)]
    assert keys == sorted(keys)
