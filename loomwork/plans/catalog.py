"""Registered queries over the driver tables, each with its statement for another SQL engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import answers, text
from loomwork.operators import quantiles, rows
from loomwork.operators.neighbours import dense_topk
from loomwork.plans.bindings import ATTEMPTS_SQL, MCQ_SQL, attempts, load, mcq

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


_PASS = "CASE WHEN c = 0 THEN 0.0 WHEN n - c < {k} THEN 1.0 ELSE 1.0 - list_product(list_transform(range((n - c + 1)::BIGINT, (n + 1)::BIGINT), lambda i: 1 - {k}.0::DOUBLE / i)) END"


@query(f"WITH {ATTEMPTS_SQL} SELECT macro_cat, count(*) AS problems, " + ", ".join(f"round(avg({_PASS.format(k=k)}), 6) AS pass_{k}" for k in (1, 3, 8)) + " FROM a GROUP BY macro_cat")
def pass_at_k_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir)
    p = {k: F.round(F.avg(answers.pass_at_k(F.col("n"), F.col("c"), k)), 6).alias(f"pass_{k}") for k in (1, 3, 8)}
    return a.groupBy("macro_cat").agg(F.count(F.lit(1)).alias("problems"), *p.values())


@query(f"WITH {ATTEMPTS_SQL} SELECT count(*) AS problems, round(avg(c / 8.0::DOUBLE), 6) AS mean_at_8 FROM a")
def mean_at_k_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts(spark, sf_dir).agg(F.count(F.lit(1)).alias("problems"), F.round(F.avg(F.col("c") / 8), 6).alias("mean_at_8"))


@query(f"WITH {ATTEMPTS_SQL} SELECT source, round(avg(first), 6) AS pass1, round(avg(any_), 6) AS pass8, round(avg(any_ - first), 6) AS gap FROM a GROUP BY source")
def first_vs_any_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return attempts(spark, sf_dir).groupBy("source").agg(
        mean(F.col("first"), "pass1"), mean(F.col("any"), "pass8"), mean(F.col("any") - F.col("first"), "gap")
    )


@query(f"WITH {ATTEMPTS_SQL} SELECT source, c::BIGINT AS c, count(*) AS problems FROM a GROUP BY source, c")
def correct_count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts(spark, sf_dir).groupBy("source", F.col("c").cast("long").alias("c")).agg(F.count(F.lit(1)).alias("problems"))


@query("SELECT lines, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey) GROUP BY lines")
def count_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    return per.groupBy("lines").agg(F.count(F.lit(1)).alias("orders"))


@query(f"WITH {ATTEMPTS_SQL} SELECT l_orderkey AS problem, c::BIGINT AS correct, boxed::BIGINT AS boxed FROM a WHERE c BETWEEN 1 AND 7")
def frontier_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir).where(F.col("c").between(1, 7))
    return a.select(F.col("l_orderkey").alias("problem"), F.col("c").cast("long").alias("correct"), F.col("boxed").cast("long").alias("boxed"))


@query(f"""WITH {ATTEMPTS_SQL} SELECT l_orderkey AS problem, c::BIGINT AS correct, boxed::BIGINT AS boxed, n::BIGINT AS n, row_number() OVER (ORDER BY md5('42|' || l_orderkey), l_orderkey) AS place FROM a WHERE c BETWEEN 1 AND 7
QUALIFY place <= 100""")
def frontier_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems answered right by some samples but not by all, in a drawn order, 100 at most."""
    a = attempts(spark, sf_dir).where(F.col("c").between(1, 7)).select(F.col("l_orderkey").alias("problem"), "c", "boxed", "n")
    first = rows.numbered(rows.drawn(a, 42, "problem", 100), [], [rows.hash_order(42, "problem"), F.col("problem")], "place", "size")
    return first.select("problem", F.col("c").cast("long").alias("correct"), F.col("boxed").cast("long").alias("boxed"), F.col("n").cast("long").alias("n"), "place")


@query(f"""WITH {ATTEMPTS_SQL} SELECT macro_cat, CASE WHEN macro_cat IS NULL THEN 'overall' ELSE 'macro' END AS section, count(*) AS problems,
round(avg(c / 8.0::DOUBLE), 6) AS accuracy, round(avg(boxed / 8.0::DOUBLE), 6) AS box_rate FROM a GROUP BY GROUPING SETS ((macro_cat), ())""")
def category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir)
    mean = lambda c, n: F.round(F.avg(F.col(c) / 8), 6).alias(n)
    sets = a.groupingSets([[F.col("macro_cat")], []], "macro_cat").agg(
        F.grouping("macro_cat").alias("g"), F.count(F.lit(1)).alias("problems"), mean("c", "accuracy"), mean("boxed", "box_rate")
    )
    return sets.select("macro_cat", F.when(F.col("g") == 1, "overall").otherwise("macro").alias("section"), "problems", "accuracy", "box_rate")



_UID = r"substr(sha256(regexp_replace(lower(regexp_replace(text, '^[ \t-\r]+|[ \t-\r]+$', '', 'g')), '[ \t-\r]+', ' ', 'g')), 1, 16)"


@query(f"SELECT doc_id, {_UID} AS uid FROM documents")
def stable_uid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.stable_uid(F.col("text")).alias("uid"))


_DOCS = f"d AS (SELECT doc_id, lang, source, n_chars, {_UID} AS uid, cast(substr(source, 4) AS INT) AS source_ord FROM documents)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars", text.stable_uid(F.col("text")).alias("uid"),
        F.substring("source", 4, 10).cast("int").alias("source_ord"),
    )


@query(f"WITH {_DOCS} SELECT uid, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY source_ord, doc_id) AS r FROM d) WHERE r = 1")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.first_wins(_docs(spark, sf_dir), "uid", "source_ord", "doc_id").select("uid", "doc_id", "source")


_CAP = ["source_ord < 5", "source_ord >= 5 AND source_ord < 12", "source_ord >= 12"]


def _cap_sql() -> str:
    parts, seen = [], ""
    for i, where in enumerate(_CAP):
        parts.append(
            f"k{i} AS (SELECT uid, min(doc_id) AS doc_id FROM d WHERE {where}{seen} GROUP BY uid ORDER BY doc_id LIMIT 100)"
        )
        seen += f" AND uid NOT IN (SELECT uid FROM k{i})"
    return f"WITH {_DOCS}, " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {i} AS part, uid, doc_id FROM k{i}" for i in range(len(_CAP)))


@query(_cap_sql())
def capped_source_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    parts = [d.where(w).select(F.lit(i).alias("part"), "uid", "doc_id") for i, w in enumerate(_CAP)]
    return rows.capped_first_wins(parts, "uid", "doc_id", 100)


@query(f"WITH {_DOCS} SELECT uid, source FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY source_ord DESC, doc_id DESC) AS r FROM d) WHERE r = 1")
def cache_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.last_wins(_docs(spark, sf_dir), "uid", "source", "source_ord", "doc_id")


@query(f"WITH {_DOCS}, b AS (SELECT {_UID} AS uid FROM benchmark UNION SELECT uid FROM d WHERE source_ord = 0) SELECT doc_id, uid FROM d WHERE uid NOT IN (SELECT uid FROM b)")
def holdout_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    block = load(spark, sf_dir, "benchmark").select(text.stable_uid(F.col("text")).alias("uid"))
    return rows.without(d, block.union(d.where("source_ord = 0").select("uid")), "uid").select("doc_id", "uid")


_BUCKET = "CASE WHEN n_options <= 2 THEN '2' WHEN n_options = 3 THEN '3' WHEN n_options = 4 THEN '4' WHEN n_options = 5 THEN '5' WHEN n_options <= 10 THEN '6-10' ELSE '11-20' END"


@query(f"WITH {MCQ_SQL} SELECT 'source' AS section, source AS key, count(*) AS n FROM mcq GROUP BY source UNION ALL SELECT 'macro_cat', macro_cat, count(*) FROM mcq GROUP BY macro_cat UNION ALL SELECT 'k_bucket', {_BUCKET}, count(*) FROM mcq GROUP BY 2")
def summary_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = mcq(spark, sf_dir).select("source", "macro_cat", text.k_bucket(F.col("n_options")).alias("k_bucket"))
    names = ["source", "macro_cat", "k_bucket"]
    sets = q.groupingSets([[F.col(n)] for n in names], *names).agg(F.count(F.lit(1)).alias("n"), *(F.grouping(n).alias(f"_{n}") for n in names))
    section = F.coalesce(*(F.when(F.col(f"_{n}") == 0, n) for n in names))
    return sets.select(section.alias("section"), F.coalesce(*names).alias("key"), "n")



@query(f"WITH {MCQ_SQL} SELECT qid, chr((65 + gold_idx)::INT) AS gold_letter, question || chr(10) || chr(10) || 'Choices:' || chr(10) || array_to_string(list_transform(options, lambda x, i: chr((64 + i)::INT) || '. ' || x), chr(10)) AS prompt FROM mcq")
def format_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.concat("question", F.lit("\n\nChoices:\n"), text.labelled(F.col("options")))
    return mcq(spark, sf_dir).select("qid", F.char(F.lit(65) + F.col("gold_idx")).alias("gold_letter"), prompt.alias("prompt"))


@query(f"WITH {MCQ_SQL} SELECT macro_cat, CASE WHEN length(o) <= 15 THEN 'S' WHEN length(o) <= 60 THEN 'M' ELSE 'L' END AS bucket, count(*) AS n, count(DISTINCT o) AS pool FROM (SELECT macro_cat, unnest(options) AS o FROM mcq) GROUP BY 1, 2")
def distractor_pool_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = mcq(spark, sf_dir).select("macro_cat", F.explode("options").alias("o"))
    return o.groupBy("macro_cat", text.length_bucket(F.col("o")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o").alias("pool")
    )


@query(f"WITH {MCQ_SQL}, r AS (SELECT qid, macro_cat, row_number() OVER (PARTITION BY macro_cat ORDER BY md5('42|' || qid), qid) AS turn FROM mcq) SELECT qid, macro_cat, turn::INT AS turn FROM r ORDER BY turn, macro_cat LIMIT 333")
def stratified_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = mcq(spark, sf_dir).select("qid", "macro_cat")
    return rows.round_robin(q, "macro_cat", [rows.hash_order(42, "qid"), F.col("qid")], 333)


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 50")
def per_language_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("lang", "doc_id")
    return rows.rank_in(d, ["lang"], [rows.hash_order(42, "doc_id"), F.col("doc_id")], 50).select("lang", "doc_id")


@query("""SELECT doc_id, lang, CASE WHEN r <= floor(n * 0.1) THEN 'test' WHEN r <= floor(n * 0.1) + floor(n * 0.2) THEN 'val' ELSE 'train' END AS split
FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)""")
def per_lang_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return rows.split_at(d, 7, "doc_id", [("test", 0.1), ("val", 0.2)], "train", by=["lang"])


@query("""WITH b AS (SELECT doc_id, lang, ((r - 1) // 32)::BIGINT AS batch FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('5|' || doc_id), doc_id) AS r,
count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE (r - 1) // 32 < n // 32), h AS (SELECT lang, batch, row_number() OVER (ORDER BY md5('5|' || coalesce(lang, '') || '|' || batch)) AS place FROM (SELECT DISTINCT lang, batch FROM b))
SELECT doc_id, b.lang, b.batch, place FROM b JOIN h ON b.batch = h.batch AND b.lang IS NOT DISTINCT FROM h.lang""")
def mono_group_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one language, in the order of the third epoch."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return rows.group_batches(d, "lang", "doc_id", 32, seed=3, epoch=2)


@query(rf"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority WHEN 1 THEN '\frac{{' || o_orderkey || '}}{{2}}' WHEN 2 THEN o_orderkey::VARCHAR END AS answer FROM orders""")
def boxed_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", _template().alias("t"))
    return o.select("o_orderkey", answers.boxed(F.col("t")).alias("answer"))


def _template() -> Column:
    key = F.col("o_orderkey").cast("string")
    which = F.col("o_orderkey") % 6
    return (
        F.when(which == 0, F.concat(F.lit("so \\boxed{"), "o_orderpriority", F.lit("} end")))
        .when(which == 1, F.concat(F.lit("\\boxed{1} then \\boxed{\\frac{"), key, F.lit("}{2}}")))
        .when(which == 2, F.concat(F.lit("x \\fbox{"), key, F.lit("}")))
        .when(which == 3, F.concat(F.lit("\\boxed{"), key))
        .when(which == 4, F.concat(F.lit("The answer is "), F.substr(F.lit("ABCD"), (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(1))))
        .otherwise(F.concat(F.lit("no "), key))
    )


_LETTERS = "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN 'X' WHEN 4 THEN substr('ABCD', (o_orderkey % 4 + 1)::INT, 1) END AS letter FROM orders"


@query(_LETTERS)
def choice_label_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letter of every order's response, of all six templates."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", _template().alias("t"))
    return o.select("o_orderkey", answers.choice_label(F.col("t")).alias("letter"))


@query(_LETTERS)
def choice_label_extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its earlier name."""
    return choice_label_extract(spark, sf_dir)


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, round(sum(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE WHEN l_linestatus = 'O' THEN -0.25 ELSE -0.75 END
- CASE WHEN l_quantity > 45 THEN 0.05 ELSE 0 END), 6) AS reward FROM lineitem GROUP BY 1, 2""")
def rollout_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = answers.reward(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_quantity") > 45)
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(r), 6).alias("reward")
    )


_SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
_CUTOFFS = (512, 1024, 1536, 2048, 3072, 4096)


@query("SELECT lang, min(n_chars) AS low, " + ", ".join(f"round(quantile_cont(n_chars, {q}), 6) AS {n}" for n, q in _SHARES.items()) + ", max(n_chars) AS high, round(avg(n_chars), 6) AS mean, "
       "round(stddev_pop(n_chars), 4) AS std, " + ", ".join(f"count_if(n_chars > {c})::BIGINT AS over_{c}, round(100.0::DOUBLE * count_if(n_chars > {c}) / count(n_chars), 6) AS over_{c}_pct" for c in _CUTOFFS) + " FROM documents GROUP BY lang")
def length_percentiles_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of a language's documents: percentiles between neighbours, and how many each cutoff would cut."""
    d = load(spark, sf_dir, "documents").select("lang", "n_chars")
    shares = quantiles.percentiles(d, "lang", "n_chars", _SHARES)
    over = lambda c: F.count_if(F.col("n_chars") > c)
    more = d.where("n_chars IS NOT NULL").groupBy(F.col("lang").alias("_l")).agg(
        F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_pop("n_chars"), 4).alias("std"),
        *(x for c in _CUTOFFS for x in (over(c).alias(f"over_{c}"), F.round(100.0 * over(c) / F.count("n_chars"), 6).alias(f"over_{c}_pct"))),
    )
    rounded = shares.select("lang", "low", "high", *(F.round(n, 6).alias(n) for n in _SHARES))
    return rounded.join(more, F.col("lang").eqNullSafe(F.col("_l"))).drop("_l")


@query("SELECT lang, " + ", ".join(f"max(CASE WHEN r = floor(n * {q}::DOUBLE) + 1 THEN n_chars END) AS {n}" for n, q in _SHARES.items()) +
       " FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) GROUP BY lang")
def length_percentiles_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths at whole places of a language's documents in order."""
    d = load(spark, sf_dir, "documents").select("lang", "n_chars")
    return quantiles.at_places(d, "lang", "n_chars", {n: F.floor(F.col("n") * q) for n, q in _SHARES.items()}).select("lang", *_SHARES)


@query("""WITH l AS (SELECT DISTINCT lang FROM documents), s AS (SELECT DISTINCT coalesce(source, '') AS source FROM documents), c AS (SELECT lang, coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY ALL),
z AS (SELECT l.lang, s.source, coalesce(n, 0) AS n FROM l CROSS JOIN s LEFT JOIN c ON c.lang IS NOT DISTINCT FROM l.lang AND c.source = s.source)
SELECT lang, string_agg(source || '=' || n, ' ' ORDER BY source) AS counts, sum(n)::BIGINT AS total FROM z GROUP BY lang""")
def lang_subject_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a language with the documents of every source, 0 where it has none."""
    d = load(spark, sf_dir, "documents").select("lang", F.coalesce("source", F.lit("")).alias("source"))
    names = sorted(r.source for r in d.select("source").distinct().limit(10_001).collect())
    if len(names) > 10_000:
        raise ValueError("a table of over 10000 columns")
    own = F.map_from_entries(F.collect_list(F.struct("source", "n")))
    per = d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(own.alias("m"), F.sum("n").alias("total"))
    cell = lambda s: F.concat(s, F.lit("="), F.coalesce(F.try_element_at("m", s), F.lit(0)).cast("string"))
    return per.select("lang", F.array_join(F.transform(F.array(*map(F.lit, names)), cell), " ").alias("counts"), "total")


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), l AS (SELECT DISTINCT lang FROM documents), s AS (SELECT DISTINCT source FROM documents)
SELECT l.lang, s.source, coalesce(n, 0)::BIGINT AS n FROM l CROSS JOIN s LEFT JOIN c ON c.lang IS NOT DISTINCT FROM l.lang AND c.source IS NOT DISTINCT FROM s.source""")
def lang_subject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every language and source, nulls among them, 0 where a pair has none; one row a pair."""
    d = load(spark, sf_dir, "documents").select("lang", "source")
    cells = d.select("lang").distinct().crossJoin(d.select("source").distinct()).withColumn("n", F.lit(0).cast("long"))
    counts = d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(cells).groupBy("lang", "source").agg(F.sum("n").alias("n"))


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(html, '(?i)!\\[[^\\]]*\\]\\(|<img|<image_\\d+>')")
def image_marker_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").where(~F.col("html").rlike(text.IMAGE_MARKER)).select("page_id")


@query("SELECT o_orderpriority, step::INT AS step, n FROM (SELECT o_orderpriority, CAST(regexp_extract(o_orderpriority, '\\d+') AS INT) AS step, count(*) AS n FROM orders GROUP BY 1) ORDER BY step")
def natural_sort_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.regexp_extract("o_orderpriority", r"\d+", 0).cast("int").alias("step")
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select("o_orderpriority", step, "n").orderBy("step")


@query("""WITH t AS (SELECT conv_id, turn, role || ': ' || text AS line FROM conversations), c AS (SELECT conv_id, count(*) AS n, string_agg(line, chr(10) ORDER BY turn, line) AS rendered FROM t GROUP BY conv_id)
SELECT conv_id, n, md5(rendered) AS digest FROM c""")
def sft_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))
    c = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("m"))
    return c.select("conv_id", "n", F.md5(F.array_join(F.transform("m", lambda x: x["line"]), "\n")).alias("digest"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, vec_id, similarity, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM s) WHERE r <= 5""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    near = dense_topk(e, e.where("id % 50 = 0"), 5)
    return near.select(F.col("asked").alias("query_id"), F.col("id").alias("vec_id"), "similarity", "rank")
