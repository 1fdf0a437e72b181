"""Registered queries of splits, samples, joins on keys and small reports; registers with the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import fixed, records, responses, text
from loomwork.operators import rows
from loomwork.operators.scoring import shares
from loomwork.plans.bindings import MCQ_SQL, load, mcq
from loomwork.plans.catalog import _docs, _DOCS, query
from loomwork.plans.responses import _COMP, completions

_H = "md5('{0}|' || {1})"


def _ranked(seed: int, source: str, key: str, by: str = "") -> str:
    return f"SELECT *, row_number() OVER ({by} ORDER BY {_H.format(seed, key)}, {key}) AS r, count(*) OVER ({by}) AS n FROM {source}"


@query(f"SELECT doc_id, CASE WHEN r <= greatest(1, round(n * 0.05)) THEN 'test' ELSE 'train' END AS split FROM ({_ranked(42, 'documents', 'doc_id')})")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 % of all rows, one at least, as the test part."""
    d = load(spark, sf_dir, "documents").select("doc_id")
    return rows.split_by(d, 42, "doc_id", [("test", lambda n: F.greatest(F.lit(1), F.round(n * 0.05)))], "train")


@query(f"""WITH s AS (SELECT lang, count(*) AS c, sum(count(*)) OVER ()::BIGINT AS n, ceil(sum(count(*)) OVER ()::BIGINT * 0.1::DOUBLE)::BIGINT AS t FROM documents GROUP BY lang),
k AS (SELECT lang, c * t // n + (row_number() OVER (ORDER BY c * t % n DESC, lang NULLS FIRST) <= t - sum(c * t // n) OVER ())::INT AS take FROM s)
SELECT doc_id, r.lang, CASE WHEN r <= take THEN 'test' ELSE 'train' END AS split FROM ({_ranked(42, 'documents', 'doc_id', 'PARTITION BY lang')}) r JOIN k ON r.lang IS NOT DISTINCT FROM k.lang""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all rows as the test part, each stratum by its share of them."""
    return rows.stratified(load(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 42, "doc_id", 0.1)


@query(f"""SELECT doc_id, CASE WHEN r <= greatest(16, round(n * 0.05)) THEN 'eval' ELSE 'train' END AS pairs, CASE WHEN r <= least(64, greatest(1, n // 10)) THEN 'eval'
 WHEN r <= least(64, greatest(1, n // 10)) + 300 THEN 'train' ELSE 'unused' END AS capped FROM ({_ranked(42, 'documents', 'doc_id')})""")
def eval_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out for evaluation: 5 % but 16 at least; or a tenth but 64 at most, with 300 rows to train on."""
    d = load(spark, sf_dir, "documents").select("doc_id")
    ranked = rows.numbered(d, [], [rows.hash_order(42, "doc_id"), F.col("doc_id")], "_at", "_size")
    pairs = rows.cut_label([("eval", lambda n: F.greatest(F.lit(16), F.round(n * 0.05)))], "train")
    size = lambda n: F.least(F.lit(64), F.greatest(F.lit(1), F.floor(n / 10)))
    capped = rows.cut_label([("eval", size), ("train", lambda n: F.lit(300))], "unused")
    return ranked.select("doc_id", pairs.alias("pairs"), capped.alias("capped"))


@query(f"SELECT doc_id FROM ({_ranked(42, 'documents', 'doc_id')}) WHERE r <= 100")
def quick_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 documents drawn for a quick test."""
    return rows.drawn(load(spark, sf_dir, "documents").select("doc_id"), 42, "doc_id", 100)


@query(f"SELECT source, doc_id FROM ({_ranked(1, 'documents', 'doc_id', 'PARTITION BY source')}) WHERE r <= 120 // (SELECT count(DISTINCT source) FROM documents)")
def equal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120 rows in equal shares of the sources; a source that has fewer is an error."""
    d = load(spark, sf_dir, "documents").select("source", "doc_id")
    return rows.equal_share(d, "source", [rows.hash_order(1, "doc_id"), F.col("doc_id")], 120).select("source", "doc_id")


@query(f"SELECT source, doc_id FROM ({_ranked(2, 'documents', 'doc_id', 'PARTITION BY source')}) WHERE r <= least(5, greatest(1, floor(0.05 * n)))")
def calibration_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 % of each source, one row at least and 5 at most."""
    d = load(spark, sf_dir, "documents").select("source", "doc_id")
    size = d.groupBy("source").agg(F.least(F.lit(5), F.greatest(F.lit(1), F.floor(0.05 * F.count(F.lit(1))))).alias("k"))
    first = rows.rank_in(d, ["source"], [rows.hash_order(2, "doc_id"), F.col("doc_id")], 5)
    return first.join(size, "source").where("rank <= k").select("source", "doc_id")


@query(f"""WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id),
s AS (SELECT 'pairs' AS part, conv_id AS id, texts[1] AS prompt, texts[2] AS completion FROM c WHERE len(texts) = 2 UNION ALL SELECT 'docs', doc_id, text, source FROM documents)
SELECT part, id, md5(prompt) AS prompt, md5(completion) AS completion FROM ({_ranked(9, 's', 'id', 'PARTITION BY part')}) WHERE r <= CASE part WHEN 'docs' THEN 30 ELSE 15 END""")
def fixed_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed numbers of rows of each part; two-message conversations are unpacked, longer ones belong to no part."""
    turn = F.array_sort(F.collect_list(F.struct("turn", "text")))
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(turn.alias("m")).where(F.size("m") == 2)
    pairs = c.select(F.lit("pairs").alias("part"), F.col("conv_id").alias("id"), F.col("m")[0]["text"].alias("prompt"), F.col("m")[1]["text"].alias("completion"))
    docs = load(spark, sf_dir, "documents").select(F.lit("docs").alias("part"), F.col("doc_id").alias("id"), F.col("text").alias("prompt"), F.col("source").alias("completion"))
    order, limits = [rows.hash_order(9, "id"), F.col("id")], {"pairs": 15, "docs": 30}
    both = rows.rank_in(pairs, ["part"], order, limits["pairs"]).unionByName(rows.rank_in(docs, ["part"], order, limits["docs"]))
    return both.select("part", "id", F.md5("prompt").alias("prompt"), F.md5("completion").alias("completion"))


@query("""WITH m AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, len(t) - 1 AS n_prompt, md5(array_to_string(t[1:len(t)-1], '')) AS prompt, md5(t[-1]) AS completion, md5(array_to_string(t, '')) AS whole FROM m""")
def prompt_only_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without their last message, that message, and all contents as one text."""
    turn = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(turn.alias("m"))
    prompt = records.without_last(F.col("m"))
    return c.select(
        "conv_id", F.size(prompt).cast("long").alias("n_prompt"), F.md5(records.message_text(prompt)).alias("prompt"),
        F.md5(F.element_at("m", -1)["content"]).alias("completion"), F.md5(records.message_text(F.col("m"))).alias("whole"),
    )


_CACHE = "cache AS (SELECT qid, 'because ' || source || qid AS cot FROM mcq WHERE source = 'F')"


@query(f"""WITH {MCQ_SQL}, {_CACHE}, t AS (SELECT m.*, chr((65 + gold_idx)::INT) AS letter, CASE WHEN m.qid % 4 = 0 THEN ' own ' || m.qid END AS own, c.cot FROM mcq m LEFT JOIN cache c USING (qid)),
w AS (SELECT *, CASE WHEN own IS NOT NULL THEN 'loader' WHEN cot IS NOT NULL THEN 'distilled' ELSE 'synthetic' END AS cot_source,
 coalesce(trim(own), cot, 'Among the options, the one that best matches the question is "' || gold || '", which is option ' || letter || '.') AS reasoning FROM t)
SELECT qid, cot_source, cot_source <> 'synthetic' AS kept_if_strict, letter AS gold_letter, n_options::INT AS n_options, md5('<think>' || chr(10) || reasoning || chr(10) || '</think>' || chr(10) || chr(10) || 'The answer is ' || chr(92) || 'boxed{{' || letter || '}}') AS assistant,
 md5('The correct answer is ' || chr(92) || 'boxed{{' || letter || '}}') AS plain FROM w""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as messages: the record's own explanation, else the cache's, else a made-up sentence that a strict build drops."""
    q = mcq(spark, sf_dir)
    cache = q.where("source = 'F'").select("qid", F.concat(F.lit("because "), "source", F.col("qid").cast("string")).alias("cot"))
    q = q.join(cache, "qid", "left").withColumn("own", F.when(F.col("qid") % 4 == 0, F.concat(F.lit(" own "), F.col("qid").cast("string"))))
    letter = F.char(F.lit(65) + F.col("gold_idx"))
    kind = F.when(F.col("own").isNotNull(), "loader").when(F.col("cot").isNotNull(), "distilled").otherwise("synthetic")
    reasoning = F.coalesce(records.strip(F.col("own")), records.strip(F.col("cot")), records.made_up(F.col("gold"), letter))
    chat = records.messages(F.col("question"), records.reasoned(reasoning, letter))
    return q.select(
        "qid", kind.alias("cot_source"), (kind != "synthetic").alias("kept_if_strict"), letter.alias("gold_letter"), "n_options",
        F.md5(F.element_at(chat, -1)["content"]).alias("assistant"), F.md5(records.boxed_line(fixed.PLAIN_LINE, letter)).alias("plain"),
    )


@query("""SELECT o_orderkey AS id, o_orderstatus AS s FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)""")
def excluded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose key no excluded line has."""
    block = load(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("id"))
    return rows.without(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s")), block, "id")


@query(f"WITH {_DOCS}, t AS (SELECT uid FROM d WHERE source_ord > 3) SELECT doc_id, uid FROM d WHERE source_ord <= 3 AND uid NOT IN (SELECT uid FROM t)")
def dev_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Development texts that no training source holds."""
    d = _docs(spark, sf_dir)
    return rows.without(d.where("source_ord <= 3"), d.where("source_ord > 3").select("uid"), "uid").select("doc_id", "uid")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 4)")
def resume_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with fewer than four lines done."""
    done = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return rows.incomplete(load(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey", 4)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000)")
def complete_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders before the first bad one."""
    o = load(spark, sf_dir, "orders")
    return rows.good_prefix(o, "o_orderkey", ~((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000))).select("o_orderkey")


@query("""WITH p AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
s AS (SELECT count_if(l_returnflag = 'R')::BIGINT AS c, count(*) AS n, row_number() OVER (ORDER BY l_orderkey) AS place FROM lineitem GROUP BY l_orderkey) SELECT place, o_orderkey, o_orderpriority, c, n FROM p JOIN s USING (place)""")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of questions and the scores of another table, in step."""
    lines = load(spark, sf_dir, "lineitem")
    pool = load(spark, sf_dir, "orders").join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_orderpriority")
    scores = lines.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("c"), F.count(F.lit(1)).alias("n"))
    left = rows.numbered(pool, [], [F.col("o_orderkey")], "place", "size").drop("size")
    right = rows.numbered(scores, [], [F.col("l_orderkey")], "place", "size").drop("size", "l_orderkey")
    return rows.by_position(left, right, "place")


@query("""WITH b AS (SELECT p_name, arg_max(p_brand, p_partkey) AS category FROM part WHERE p_size > 15 AND p_name NOT LIKE 'a%' GROUP BY p_name)
SELECT p_partkey, coalesce(category, 'Unknown') AS category FROM part LEFT JOIN b USING (p_name)""")
def category_of_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's category by its name, the last one told; Unknown for names that are not told."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    told = rows.keyed_last(p.where("p_size > 15 AND p_name NOT LIKE 'a%'"), "p_name", "p_brand", "p_partkey")
    return p.select("p_partkey", "p_name").join(told, "p_name", "left").select("p_partkey", F.coalesce("p_brand", F.lit("Unknown")).alias("category"))


@query("""WITH a AS (SELECT doc_id, lang FROM documents), b AS (SELECT doc_id FROM labels) SELECT lang, count(*) AS total, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM b)) AS missing,
 count(*) FILTER (doc_id IN (SELECT doc_id FROM b)) AS there FROM a GROUP BY lang""")
def missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents a language that have no label yet."""
    b = load(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("has", F.lit(True))
    d = load(spark, sf_dir, "documents").select("doc_id", "lang").join(b, "doc_id", "left")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("has").isNull()).alias("missing"), F.count("has").alias("there"))


@query("""WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en'), b AS (SELECT doc_id FROM labels)
SELECT 'both' AS kind, doc_id FROM (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b) UNION ALL SELECT 'first_only', doc_id FROM (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b)
UNION ALL SELECT 'either', doc_id FROM (SELECT doc_id FROM a UNION SELECT doc_id FROM b) UNION ALL SELECT 'all_rows', doc_id FROM (SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b)""")
def id_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, difference, union and concatenation of two sets of ids."""
    a = load(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    b = load(spark, sf_dir, "labels").select("doc_id")
    kinds = {"both": a.intersect(b), "first_only": a.exceptAll(b).distinct(), "either": a.union(b).distinct(), "all_rows": a.unionByName(b)}
    named = [df.select(F.lit(k).alias("kind"), "doc_id") for k, df in kinds.items()]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


@query("SELECT count(*) AS shared, count(*) = 0 AS healthy FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def overlap_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two samples share an id."""
    o = load(spark, sf_dir, "orders")
    shared = o.where("o_orderstatus = 'P'").select("o_custkey").intersect(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))
    return shared.agg(F.count(F.lit(1)).alias("shared")).withColumn("healthy", F.col("shared") == 0)


@query("""WITH g AS (SELECT t.x AS temperature, p.x AS top_p FROM (VALUES (0.3::DOUBLE), (0.6), (0.9), (1.2)) t(x), (VALUES (0.8::DOUBLE), (0.95)) p(x)),
m AS (SELECT (0.3 * (1 + o_orderkey % 3))::DOUBLE AS t, avg(o_totalprice) AS score FROM orders GROUP BY 1)
SELECT 't' || replace(temperature::VARCHAR, '.', 'p') || '_p' || replace(top_p::VARCHAR, '.', 'p') AS run, temperature, top_p, round(score, 2) AS score FROM g LEFT JOIN m ON round(t, 1) = temperature""")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of two short lists of parameters, with its score if there is one."""
    grid = spark.createDataFrame([(t, p) for t in (0.3, 0.6, 0.9, 1.2) for p in (0.8, 0.95)], "temperature double, top_p double")
    o = load(spark, sf_dir, "orders")
    m = o.groupBy(F.round(0.3 * (1 + F.col("o_orderkey") % 3), 1).alias("temperature")).agg(F.avg("o_totalprice").alias("score"))
    run = F.concat(F.lit("t"), records.number_tag(F.col("temperature")), F.lit("_p"), records.number_tag(F.col("top_p")))
    return grid.join(m, "temperature", "left").select(run.alias("run"), "temperature", "top_p", F.round("score", 2).alias("score"))


@query("SELECT DISTINCT s_nationkey AS run FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def unscored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without a scored file yet."""
    scored = load(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("run"))
    return rows.without(load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("run")).distinct(), scored, "run")


@query("SELECT lower(p_type) AS category, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, category LIMIT 20")
def category_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 commonest categories."""
    return load(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(20)


@query("SELECT o_orderpriority AS category, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders), 6) AS pct FROM orders GROUP BY 1")
def category_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category")), "category")


@query(f"WITH {MCQ_SQL} SELECT macro_cat, n_options::BIGINT AS n_options, count(*) AS n FROM mcq GROUP BY 1, 2")
def choice_count_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcq(spark, sf_dir).groupBy("macro_cat", F.col("n_options").cast("long").alias("n_options")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_COMP}, p AS (SELECT qid, any_value(gold) AS macro, count_if(coalesce(letter = gold, false)) AS c, count(*) AS n, count_if(letter <> gold) AS wrong FROM comp GROUP BY qid)
SELECT macro, CASE WHEN c = 0 THEN 'no_correct' WHEN wrong = 0 THEN 'no_incorrect' ELSE 'pair' END AS outcome, count(*) AS problems, round(avg(c / n::DOUBLE), 6) AS p_correct FROM p GROUP BY 1, 2""")
def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why problems give no pair, and how often they are answered right, by category."""
    c = completions(spark, sf_dir)
    wrong = F.col("letter") != F.col("gold")
    per = c.groupBy("qid").agg(F.max("gold").alias("macro"), F.count_if("right").alias("c"), F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong"))
    outcome = F.when(F.col("c") == 0, "no_correct").when(F.col("wrong") == 0, "no_incorrect").otherwise("pair")
    return per.groupBy("macro", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("problems"), F.round(F.avg(F.col("c") / F.col("n")), 6).alias("p_correct"))


@query(f"""WITH {_COMP}, p AS (SELECT qid, count_if(coalesce(letter = gold, false)) AS c, count(letter) AS b, count(DISTINCT letter) AS answers FROM comp GROUP BY qid)
SELECT c::BIGINT AS correct, count(*) AS groups, round(avg(b / 8.0::DOUBLE), 6) AS boxed_rate, round(avg(answers), 6) AS answers,
 round(avg((c * 1.0 + (b - c) * -0.25 + (8 - b) * -0.75) / 8.0::DOUBLE), 6) AS reward FROM p GROUP BY c""")
def rollout_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of eight responses by how many are right: rewards, boxed rate and distinct answers."""
    reward = F.when(F.col("right"), 1.0).when(F.col("letter").isNotNull(), -0.25).otherwise(-0.75)
    per = completions(spark, sf_dir).groupBy("qid").agg(
        F.count_if("right").alias("correct"), F.count("letter").alias("b"), F.count_distinct("letter").alias("a"), F.avg(reward).alias("w")
    )
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return per.groupBy("correct").agg(F.count(F.lit(1)).alias("groups"), mean(F.col("b") / 8, "boxed_rate"), mean("a", "answers"), mean("w", "reward"))


@query(f"WITH {_COMP} SELECT gold, count_if(letter = gold)::BIGINT AS kept, count(*) AS total, round(count_if(letter = gold) / count(*)::DOUBLE, 6) AS retention FROM comp GROUP BY gold")
def retention_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.count_if("right")
    return completions(spark, sf_dir).groupBy("gold").agg(kept.alias("kept"), F.count(F.lit(1)).alias("total"), F.round(kept / F.count(F.lit(1)), 6).alias("retention"))


@query("""WITH c AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'final' WHEN 1 THEN 'best' ELSE 'checkpoint-' || p_size END AS name FROM part)
SELECT name, row_number() OVER (ORDER BY CASE WHEN name LIKE 'checkpoint-%' THEN 0 WHEN name = 'final' THEN 1 ELSE 2 END, coalesce(TRY_CAST(substr(name, 12) AS INT), 0), name)::INT AS place FROM c""")
def checkpoint_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints by step, then the final one, then others."""
    name = F.expr("CASE p_size % 4 WHEN 0 THEN 'final' WHEN 1 THEN 'best' ELSE 'checkpoint-' || p_size END")
    c = load(spark, sf_dir, "part").select(name.alias("name")).distinct()
    step = F.expr("try_cast(nullif(regexp_extract(name, '^checkpoint-([0-9]+)$', 1), '') AS int)")
    kind = F.when(step.isNotNull(), 0).when(F.col("name") == "final", 1).otherwise(2)
    return rows.numbered(c, [], [kind, F.coalesce(step, F.lit(0)), F.col("name")], "place").select("name", F.col("place").cast("int").alias("place"))


@query(f"WITH {MCQ_SQL} SELECT qid, (n_options % 7)::BIGINT AS missing, ((row_number() OVER (PARTITION BY n_options % 7 ORDER BY qid) - 1) // 16)::BIGINT AS batch FROM mcq")
def consecutive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 16 questions that lack as many options."""
    q = mcq(spark, sf_dir).select("qid", (F.col("n_options") % 7).cast("long").alias("missing"))
    return rows.numbered(q, ["missing"], [F.col("qid")]).select("qid", "missing", F.expr("(rank - 1) div 16").alias("batch"))


@query(f"WITH {_DOCS}, p AS (SELECT uid, count(*) AS n, min(doc_id) AS first FROM d GROUP BY uid) SELECT count(*) AS kept, sum(n - 1)::BIGINT AS dropped, sum(first)::BIGINT AS check_sum FROM p")
def prompt_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts kept and dropped as repeats."""
    per = _docs(spark, sf_dir).groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return per.agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("n") - 1).alias("dropped"), F.sum("first").alias("check_sum"))


@query("""WITH t AS (SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens, source FROM documents), k AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM t WHERE tokens <= 400)
SELECT k.doc_id, k.tokens, k.source IN ('src0', 'src1') OR k.source LIKE 'src1%' AS in_scope, k.source IN ('src3', 'src4') AS weak FROM k WHERE r <= 150""")
def token_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 150 documents of at most 400 tokens, as the length in characters stands for them; and source filters."""
    tokens = F.ceil(F.length("text") / 4).cast("long")
    d = load(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"), "source").where("tokens <= 400").orderBy("doc_id").limit(150)
    prefixes = F.col("source").isin("src0", "src1") | F.col("source").startswith("src1")
    return d.select("doc_id", "tokens", prefixes.alias("in_scope"), F.col("source").isin("src3", "src4").alias("weak"))


@query(rf"""WITH {MCQ_SQL}, p AS (SELECT qid, question || CASE qid % 3 WHEN 0 THEN chr(10) || chr(10) || 'Choices:' WHEN 1 THEN chr(10) || 'Choices:' ELSE '' END || chr(10) || 'A. x' AS prompt, question FROM mcq)
SELECT qid, substr(sha256(lower(CASE WHEN qid % 3 < 2 THEN question ELSE regexp_replace(prompt, '\s+', ' ', 'g') END)), 1, 16) AS uid, sha1(regexp_replace(lower(trim(prompt)), '\s+', ' ', 'g')) AS prompt_key FROM p""")
def prompt_stem_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of prompts: of what stands before the choices, and of all of it."""
    mark = F.when(F.col("qid") % 3 == 0, "\n\nChoices:").when(F.col("qid") % 3 == 1, "\nChoices:").otherwise("")
    p = mcq(spark, sf_dir).select("qid", F.concat("question", mark, F.lit("\nA. x")).alias("prompt"))
    return p.select("qid", text.stable_uid(records.stem(F.col("prompt"))).alias("uid"), text.prompt_key(F.col("prompt")).alias("prompt_key"))


@query(f"""WITH {MCQ_SQL} SELECT qid, question, gold, len(options) - 1 AS n_others, array_to_string(list_filter(options, lambda o: o <> gold), '|') AS others FROM mcq""")
def reverse_parse_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question, gold and other options read back from a lettered prompt."""
    prompt = F.concat("question", F.lit("\n\n"), text.labelled(F.col("options"), ") "), F.lit("\n"))
    q = mcq(spark, sf_dir).select("qid", records.parse_lettered(prompt, F.char(F.lit(65) + F.col("gold_idx"))).alias("p"))
    return q.select("qid", "p.question", "p.gold", F.size("p.others").cast("long").alias("n_others"), F.array_join("p.others", "|").alias("others"))


#: Own wordings; a user passes the wordings to use.
_TEMPLATES = {
    ("short", False): "Q: {question}\nA: {gold}\nSay briefly why.", ("short", True): "Q: {question}\nIs it {gold}? Say briefly why.",
    ("long", False): "Q: {question}\nA: {gold}\nReason step by step.", ("long", True): "Q: {question}\nIs it {gold}? Reason step by step.",
}


@query("""WITH p AS (SELECT p_partkey, ['mmlu', 'boolq', 'ecqa', 'mmlu_world'][p_partkey % 4 + 1] AS source, CASE p_partkey % 3 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'true, No' ELSE p_name END AS gold, ' ' || p_brand || ' ' AS q FROM part),
s AS (SELECT *, CASE WHEN source LIKE 'mmlu%' THEN 'long' ELSE 'short' END AS style FROM p)
SELECT p_partkey, style, CASE style WHEN 'long' THEN 1000 ELSE 200 END::INT AS least, p_partkey % 3 < 2 AS is_binary, md5('Q: ' || trim(q) || chr(10) || CASE WHEN p_partkey % 3 < 2 THEN 'Is it ' || trim(gold) || '? ' ELSE 'A: ' || trim(gold) || chr(10) END
 || CASE style WHEN 'long' THEN 'Reason step by step.' ELSE 'Say briefly why.' END) AS prompt FROM s""")
def teacher_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A teacher's prompt for each question: style by source, wording by style and kind of gold."""
    p = load(spark, sf_dir, "part").selectExpr(
        "p_partkey", "element_at(array('mmlu', 'boolq', 'ecqa', 'mmlu_world'), cast(p_partkey % 4 + 1 AS int)) AS source",
        "CASE p_partkey % 3 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'true, No' ELSE p_name END AS gold", "' ' || p_brand || ' ' AS q",
    )
    style = records.style_of(F.col("source"))
    made = records.teacher_prompt(F.col("q"), F.col("gold"), style, _TEMPLATES)
    return p.select("p_partkey", style.alias("style"), records.least_chars(F.col("source"), style).alias("least"), records.is_binary(F.col("gold")).alias("is_binary"), F.md5(made).alias("prompt"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE substr(p_name, 1, 2) END AS lang, CASE p_partkey % 3 WHEN 0 THEN 'unknown' ELSE trim(regexp_replace(' /' || p_type || ' (x)', '[^A-Za-z0-9_.-]+', '_', 'g'), '_') END AS safe FROM part""")
def names_and_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages told by ids and file names made of labels."""
    p = load(spark, sf_dir, "part")
    idx = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit("_x_1"))).otherwise(F.col("p_name"))
    label = F.when(F.col("p_partkey") % 3 == 0, " /() ").otherwise(F.concat(F.lit(" /"), "p_type", F.lit(" (x)")))
    return p.select("p_partkey", records.language_of(idx).alias("lang"), records.safe_name(label).alias("safe"))


@query(f"""WITH {_COMP}, r AS (SELECT qid, gold, attempt, regexp_replace(text, '</think>.*', '', 's') AS thinking, coalesce(letter = gold, false) AS ok FROM comp), s AS (SELECT *, length(trim(thinking)) AS n FROM r WHERE ok),
best AS (SELECT qid, arg_min(trim(thinking), n * 10 + attempt) AS thinking FROM s WHERE n <= 20 GROUP BY qid), tried AS (SELECT DISTINCT qid FROM comp WHERE gold <> 'C'),
f AS (SELECT o.o_orderkey AS qid, t.qid IS NOT NULL AS tried, b.thinking FROM orders o LEFT JOIN tried t ON t.qid = o.o_orderkey LEFT JOIN best b ON b.qid = o.o_orderkey AND t.qid IS NOT NULL)
SELECT qid, CASE WHEN NOT tried THEN 'passthrough' WHEN thinking IS NOT NULL THEN 'replaced' WHEN qid % 2 = 0 THEN 'fallback' ELSE 'dropped' END AS route, md5(thinking) AS thinking FROM f""")
def trace_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's way into the next corpus: replaced by its shortest clean right trace, kept as it was
    (fallback), dropped, or passed through because it was never tried."""
    c = completions(spark, sf_dir).withColumn("thinking", records.strip(F.substring_index("text", "</think>", 1)))
    clean = F.col("right") & (F.length("thinking") <= 20) & (responses.most_repeats(F.col("thinking")) <= 6)
    tried = c.where("gold <> 'C'")
    best = tried.groupBy("qid").agg(F.min_by("thinking", F.when(clean, F.struct(F.length("thinking"), F.col("attempt")))).alias("thinking"), F.lit(True).alias("tried"))
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid")).join(best, "qid", "left")
    route = (
        F.when(F.col("tried").isNull(), "passthrough").when(F.col("thinking").isNotNull(), "replaced")
        .when(F.col("qid") % 2 == 0, "fallback").otherwise("dropped")
    )
    return o.select("qid", route.alias("route"), F.md5("thinking").alias("thinking"))


@query(f"""WITH {_COMP}, s AS (SELECT qid, attempt, trim(regexp_replace(text, '</think>.*', '', 's')) AS thinking FROM comp WHERE letter = gold)
SELECT qid, arg_min(thinking, attempt) AS first, arg_min(thinking, length(thinking) * 10 + attempt) AS shortest, count(*) AS correct FROM s GROUP BY qid""")
def trace_select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's first and its shortest right trace."""
    c = completions(spark, sf_dir).where("right").withColumn("thinking", records.strip(F.substring_index("text", "</think>", 1)))
    return c.groupBy("qid").agg(
        F.min_by("thinking", "attempt").alias("first"), F.min_by("thinking", F.struct(F.length("thinking"), F.col("attempt"))).alias("shortest"),
        F.count(F.lit(1)).alias("correct"),
    )
