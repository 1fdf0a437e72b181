"""The corpus queries do their job on whole rows."""

import zlib

import duckdb
from pyspark.sql import functions as F

from loomwork.llm import oracles, queries


def test_digests_come_from_sharded_texts(spark, tmp_path, monkeypatch):
    rows = [(i, None if i == 5 else f"é{i} " * (30_000 if i == 7 else i % 9)) for i in range(300)] + [(None, "x"), (3, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    size = lambda t: len((t or "").encode()) + 8
    got = queries.op10_histogram_shards(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    shards = queries.histogram_shards
    monkeypatch.setattr(queries, "histogram_shards", lambda *a: shards(*a).withColumn("text", F.concat(F.lit("sharded "), "text")))
    changed = queries.op10_histogram_shards(spark, str(tmp_path)).where("doc_id = 8").first()
    assert changed.text_crc32 == zlib.crc32(("sharded " + "é8 " * 8).encode())


def test_language_without_common_words_is_judged_by_characters(spark, tmp_path):
    word = lambda n: "".join("abcdefghijklmnop"[n >> s & 15] for s in (0, 4, 8, 12))
    rows = [(d, " ".join(word(d * 100 + i) for i in range(100)), "zz") for d in range(30)]
    rows += [(30, " ".join(f"{i}{i * 7}9081" for i in range(60)), "zz"), (31, rows[0][1], None), (32, "a few words", "zz")]
    rows += [(40 + d, f"the cat and the dog saw the {word(d)} of {word(d + 9)} " * 3, "en") for d in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_distribution_quality(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    theirs = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracles.OP1})").fetchall()
    ours = {r.doc_id: r for r in got.collect()}
    assert {i: tuple(r) for i, r in ours.items()} == {r[0]: r for r in theirs} and len(theirs) == len(rows)
    assert not ours[30].base_failed and not ours[30].kept and ours[0].kept and ours[31].kept
