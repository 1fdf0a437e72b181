"""The corpus operators on small tables: brute force, round trips, nulls, ties and empty tables."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomwork.llm import ann, bpe, chat, langid, minhash, mixing, quality, sharding, text, tokenbin, warc
from loomwork.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, id string"


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(f"w{i % 97} the of and x{i}" for i in range(60))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " one more", "en", None), (4, None, "en", "b"),
        (5, "", None, "b"), (6, " \t\n", "de", "b"), (7, "two words", "de", "c"), (8, "Two\x0bWORDS", None, "c"), (9, "é à 你好 😀 ½", "fr", "c"),
        (10, "12 34 !! $$$", "fr", None), (None, base, None, None), (11, "long " * 50_000, "en", "d"), (-5, base.upper(), "en", "d"),
    ]
    return spark.createDataFrame([(i, t, lang, s, 0, 0, "x") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return [w for w in (t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]


def test_quality_counts(docs, empty):
    got = {(r.doc_id, r.n_words): r for r in quality.distribution_quality(docs).collect()}
    for r in docs.collect():
        own = words(r.text)
        row = got[r.doc_id, len(own)]
        windows = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
        covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)} if len(own) < 1000 else set(range(len(own)))
        assert row.n_repeat_words == len(covered)
        assert row.word_chars == sum(map(len, own))
        assert row.base_failed == (len(own) < 20 or 100 * len(covered) > 30 * len(own))
    assert quality.distribution_quality(docs).count() == docs.count()
    assert quality.distribution_quality(empty).count() == 0


def test_mix_hits_targets(spark, docs, empty):
    sizes = docs.select("doc_id", "source", text.n_words(F.col("text")).alias("size"))
    assert mixing.mix(sizes).count() == docs.count()
    assert mixing.mix(empty.select("doc_id", "source", F.lit(1).alias("size"))).count() == 0
    many = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 7 > 0, "cold").alias("source"), (F.col("id") % 90 + 1).alias("size")
    )
    plan = mixing.MixPlan(chunk=16)
    one, two = (sorted(map(tuple, mixing.mix(m, plan).collect()), key=str) for m in (many, many.repartition(7)))
    assert one == two
    for source in ("hot", "cold", None):
        own = [r for r in one if r[1] == source]
        taken, target = sum(r[2] * r[5] for r in own), own[0][4]
        assert abs(taken - target) <= 90 and max(r[5] for r in own) <= 2
    assert sum({r[1]: r[4] for r in one}.values()) == pytest.approx(1.5 * sum(r[2] for r in one))


def test_shards(spark, empty):
    rows = spark.range(20_000).select(
        F.when(F.col("id") < 7000, F.lit(5)).when(F.col("id") < 7010, F.lit(None)).otherwise(F.col("id") * 10**14 - 10**18).alias("k"),
        (F.col("id") % 50).alias("size"),
    )
    for part in (1 << 30, 5000):
        got = sharding.histogram_shards(rows, "k", "size", 24, part_bytes=part).collect()
        assert len(got) == 20_000
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r)
        weights = [sum(r.size for r in v) for v in by.values()]
        assert len(by) == 24 and max(weights) - min(weights) <= 0.002 * sum(weights) / 24 + 100
        assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
        keys = [r.k if r.k is not None else -(2**63) for s in sorted(by) for r in sorted(by[s], key=lambda r: r.slot)]
        assert keys == sorted(keys)
    assert sharding.histogram_shards(empty.select("doc_id", F.lit(1).alias("size")), "doc_id", "size").count() == 0


def test_bpe(docs, empty):
    import tiktoken

    ranks = bpe.load_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    table = bpe.PerfectHash(ranks)
    assert table.find([*ranks, b"no such token"]) == [*ranks.values(), -1]
    reference = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_documents(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    expected = set()
    for r in docs.collect():
        ids = np.array(reference.encode_ordinary(r.text or ""), "<u4").tobytes()
        expected.add((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in got} == expected and len(got) == docs.count()
    assert bpe.encode_documents(empty, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    own = bpe.ByteBpe(ranks, public_tokenizers.PATTERN, table)
    for s in ("a  b\n c \n\n d's  'll x", " x   y", " ", "  \n"):
        assert np.frombuffer(own.encode_batch([s])[0], "<u4").tolist() == reference.encode_ordinary(s)


def test_token_shards(docs, empty):
    from tokenizers import Tokenizer

    file = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_str(file.decode())
    got = sorted(tokenbin.word_token_file(docs, file).collect(), key=lambda r: r.start)
    start = 0
    assert [r.doc_id for r in got] == [None, *sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)]
    known = {}
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        known[r.doc_id] = (len(ids), zlib.crc32(ids.tobytes()))
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, *known[r.doc_id])
        start += r.n_tokens
    assert tokenbin.word_token_file(empty, file).count() == 0


def test_near_duplicates(spark, docs, empty):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    by = {i: v for (i, _), v in got.items()}
    assert by[2] == by[3] == (-5, False) and by[1] == (-5, False) and by[-5] == (-5, True)
    assert by[7] == (7, True) and by[8] == (7, False) and by[None] == (None, True)
    assert all(by[i] == (i, True) for i in (4, 5, 6, 9, 10, 11))
    assert minhash.near_duplicates(empty).count() == 0
    # a group just below the threshold stays apart, in one block or in many
    text_ = lambda i: " ".join(f"w{j}" if (j * 7 + i) % 23 else f"u{i}x{j}" for j in range(120))
    near = spark.createDataFrame([(i, text_(i % 40)) for i in range(60)], "doc_id long, text string")
    for size in (4_000_000, 300):
        found = minhash.near_duplicates(near, minhash.NearDup(block_items=size)).collect()
        assert {r.doc_id: r.component_id for r in found} == brute([(r.doc_id, r.text) for r in near.collect()])


def brute(rows):
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, t in rows if (w := t.split())}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[i]] == root[i] for i in root):
            break
    return root


@pytest.mark.parametrize("shape", ("random", "chain", "none"))
def test_components_equal_union_find(spark, shape):
    from loomwork.workspace import Workspace

    rng = np.random.default_rng(2)
    links = {"random": rng.integers(0, 300, (220, 2)).tolist(), "chain": [[i, i + 1] for i in range(120)], "none": []}[shape]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = minhash.components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "c"), "x").collect()
    assert sorted(map(tuple, got)) == [(i, find(i)) for i in range(300) if find(i) != i]


def test_language_id(docs, empty, spark):
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert got[1].lang_pred == "en" and got[9].lang_pred == "fr"
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (4, 5, 6, 10))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert langid.predict(docs, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = langid.held_out(F.col("doc_id"))
    pred = langid.predict(table.where(held), langid.fit(table.where(~held)))
    right = pred.join(table, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_warc(spark):
    schema = "page_id long, url string, html string, first string"
    rows = [(3, "u", "a" * 500), (2, "v\r\nX: y", "a" * 500), (2, "v", "a" * 500), (9, None, None), (8, "e", ""), (None, "n", "é"), (-4, "m", "z\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], schema)
    got = sorted((tuple(r) for r in warc.warc_archive(pages).collect()), key=str)
    first = {"a" * 500: 2, "": 8, "é": None, "z\r\n\r\n": -4}
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        f = first[html or ""]
        expected.append((i, len(data), warc.digest(data), "revisit" if i != f else "response", f if i != f else None))
    assert got == sorted(expected, key=str)
    assert warc.warc_archive(pages.limit(0)).count() == 0
    records = [warc.record(i, "u", f"page {i} ".encode() * 300, "x", None, False) for i in range(200)]
    packed = warc.archive(records, 2048, 3)
    assert list(warc.records_of(packed)) == records and len(packed) < sum(map(len, records)) / 5
    for i in (0, 5, -1, -(2**63), 2**63 - 1, None):
        assert warc.page_of(f"<urn:uuid:{warc.record_uuid(i)}>") == i


def test_chat(spark):
    hard = "<|im_end|>\n<|im_start|>user\\n </s>[INST] \\ <<SYS>>"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, None, "assistant", None), (2, 5, "sys\nrole\\n", "x"), (None, 0, None, "q")]
    got = {r.conv_id: r for r in chat.chat_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha(f"user\n{hard}\nassistant\n{hard}\nassistant\n\n") and got[1].n_turns == 3
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(hard), sha(hard))
    assert got[2].turns_sha256 == sha("sys\nrole\\n\nx\n") and got[None].turns_sha256 == sha("\nq\n")
    assert chat.chat_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_reply_tree(spark):
    from loomwork.workspace import Workspace

    # 1 -> 2 -> 3 -> 4, 2 -> 5, 9 alone, 7 <-> 8 a cycle
    rows = [(1, None, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0), (5, 2, 3.0), (9, 99, 1.0), (7, 8, 1.0), (8, 7, 1.0)]
    messages = spark.createDataFrame(rows, "id long, parent long, score double")
    for top, expected in ((1, {5: [1, 2, 5], 9: [9]}), (2, {5: [1, 2, 5], 4: [1, 2, 3, 4], 9: [9]})):
        paths = {}
        for r in chat.reply_paths(messages, Workspace(spark, "t"), top).orderBy("path", "place").collect():
            paths.setdefault(r.path, []).append(r.id)
        assert paths == expected


def _paths(messages, spark, top):
    from loomwork.workspace import Workspace

    paths = {}
    for r in sorted(chat.reply_paths(messages, Workspace(spark, "t"), top).collect(), key=lambda r: (r.path, r.place)):
        assert r.place == len(paths.setdefault(r.path, [])) + 1
        paths[r.path].append(r.id)
    return paths


@pytest.mark.parametrize("top", (1, 3))
def test_random_reply_forest_equals_a_walk(spark, top):
    rng = np.random.default_rng(11)
    rows = {}
    for i in range(300):  # few scores, so branches tie; some parents are no message
        parent = None if i < 4 else -1 - i if rng.random() < 0.02 else int(rng.integers(max(0, i - 25), i))
        rows[i] = (parent, float(rng.integers(0, 3)))
    rows |= {1000 + i: (1000 + (i + 1) % 5, 1.0) for i in range(5)} | {2000: (1002, 9.0)}  # a cycle and a message that replies to it
    walks = {}
    for leaf in rows.keys() - {p for p, _ in rows.values()}:
        path, at = [], leaf
        while at in rows and at not in path:
            path.append(at)
            at = rows[at][0]
        if at not in path:
            walks.setdefault(path[-1], []).append((-sum(rows[i][1] for i in path), leaf, path[::-1]))
    expected = {leaf: path for own in walks.values() for _, leaf, path in sorted(own)[:top]}
    messages = spark.createDataFrame([(i, p, s) for i, (p, s) in rows.items()], "id long, parent long, score double")
    assert _paths(messages, spark, top) == expected


def test_one_root_of_very_many_leaves(spark):
    n = F.lit(200_000)
    messages = spark.range(1, 200_001).select("id", F.lit(0).cast("long").alias("parent"), (F.col("id") * 7919 % n).cast("double").alias("score"))
    messages = messages.unionByName(spark.createDataFrame([(0, None, 1.0)], "id long, parent long, score double"))
    best = sorted(range(1, 200_001), key=lambda i: (-(i * 7919 % 200_000), i))[:3]
    assert _paths(messages, spark, 3) == {i: [0, i] for i in best}


def test_carried_columns_named_as_results(spark, docs):
    odd = docs.limit(5).selectExpr("doc_id", "text", "lang", "7 AS Score", "8 AS kept", "9 AS text_")
    told = langid.predict(odd, langid.fit(docs), carry=("doc_id", "Score", "text", "text_")).collect()
    assert {(r["Score_"], r["text_"], 0 <= r["score"] <= 1) for r in told} == {(7, 9, True)} and len(told) == 5
    judged = quality.distribution_quality(odd, carry=("doc_id", "kept", "text_"))
    assert judged.columns[:3] == ["doc_id", "kept_", "text_"] and {r["kept_"] for r in judged.collect()} == {8}


def test_ann(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[5:40] = x[4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int".replace(", label int", ""))
    found = {}
    for r in ann.nearest_neighbours(df, plan=ann.GraphPlan(shard_rows=400)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(found) == list(range(0, 1500, 100))
    hit = 0
    for q, own in found.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        hit += len({v for _, v, _ in own} & set(best))
        assert [r for r, _, _ in sorted(own)] == list(range(1, 11))
        assert all(s == pytest.approx(d[v]) for _, v, s in own)
    assert hit >= 0.9 * 10 * len(found)
    assert ann.nearest_neighbours(df.limit(0)).count() == 0


def test_graph_of_tight_clusters_and_shards_that_grow():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 64))[rng.integers(0, 20, 4096)] + 0.1 * rng.normal(size=(4096, 64))
    graph, q = ann.build(x, ann.GraphPlan()), x[::16]
    found = graph.search(q, 128)[0][:, :10]
    d = ((x[None] - q[:, None]) ** 2).sum(2)
    assert np.mean([len(set(f) & set(b)) for f, b in zip(found, np.argsort(d, 1)[:, :10])]) >= 9.5  # before: 6.4
    plan = ann.GraphPlan()
    assert [plan.shards_of(n) for n in (0, 1, 4096, 4097, 196_608, 786_432)] == [1, 1, 1, 2, 48, 48]
    for n in (1, 2, 3, 30):
        ids, _ = ann.build(x[:n], plan).search(x[:2], 128)
        assert all(sorted(i[i >= 0]) == list(range(n)) for i in ids)


def test_character_classes_in_one_pass(spark):
    import unicodedata

    texts = ["", None, " \t\n\x0b\x0c\r", "Ab 12, (x)! é É ½ ٣ ª ǅ 😀\x1c\x85 #$%&|<>*", "ÀÉ\n\nß—你好 a.b-c;'\"?:", "a" * 300 + " B" * 200]
    df = quality._with_counts(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"), F.col("doc_id"))
    for r in df.collect():
        t = texts[r.row] or ""
        of = lambda kind: sum(unicodedata.category(c) == kind for c in t)  # noqa: E731, B023
        assert (r.c_lower, r.c_upper, r.c_digit) == (of("Ll"), of("Lu"), of("Nd"))
        assert (r.c_space, r.c_point, r.n_chars) == (sum(c in " \t\n\x0b\x0c\r" for c in t), sum(c in ".,;:!?'\"()-" for c in t), len(t))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(text") == 1  # before: five


def test_pre_tokens_outlast_pieces(monkeypatch):
    ranks = bpe.load_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    coder = bpe.ByteBpe(ranks, public_tokenizers.PATTERN, bpe.PerfectHash(ranks))
    texts, merges, merge = [f"qzx{chr(97 + i % 26)}wv{chr(97 + i // 26)}jk, {i}" for i in range(600)], [], bpe.merge
    monkeypatch.setattr(bpe, "_MEMO_BYTES", 1 << 10)
    monkeypatch.setattr(bpe, "merge", lambda token, *a: (merges.append(token), merge(token, *a))[1])
    first = coder.encode_batch(texts)
    assert merges and [bytes(coder.decode(i)).decode() for i in first] == texts and bytes(coder.decode(b"")) == b""
    merges.clear()
    assert coder.encode_batch(texts) == first and not merges  # before: they were forgotten with the pieces
