"""Registered queries of files, sinks, gates, scored files and assembled corpora; registers with the catalogue.

Files are written by Spark from the given tables first and then read as a user's would be.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import answers, records, text, tokens
from loomwork.operators import assembly, gates, rows, scoring
from loomwork.plans.bindings import load
from loomwork.plans.building import _FORM, _TRIVIA, _shuffle_sql
from loomwork.plans.catalog import _UID, QUERIES, query
from loomwork.plans.responses import _COMP, completions
from loomwork.plans.scoring import _GENERATED, _graded_sql, responded
from loomwork.sources import files, loaders
from loomwork.streaming.ledger import Ledger, Rules, stream_into
from loomwork.workspace import Workspace


def _sorted(df: DataFrame, key: str) -> DataFrame:
    """Rows in the order of ``key`` over as many partitions as a shuffle has."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, key).sortWithinPartitions(key)


def _sorted_lines(df: DataFrame, key: str, path: str) -> None:
    """JSON lines in the order of ``key`` over the files' names."""
    _sorted(df, key).write.json(path)


@query("""WITH p AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
s AS (SELECT count_if(l_returnflag = 'R')::BIGINT AS c, count(*) AS n, row_number() OVER (ORDER BY l_orderkey) AS row_no FROM lineitem GROUP BY l_orderkey) SELECT row_no, o_orderkey, o_orderpriority, c, n FROM p JOIN s USING (row_no)""")
def zipped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool's file and its scores' file side by side, line by line."""
    work, lines = Workspace(spark, "zip"), load(spark, sf_dir, "lineitem")
    pool = load(spark, sf_dir, "orders").join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    scores = lines.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("c"), F.count(F.lit(1)).alias("n"))
    _sorted_lines(pool.select("o_orderkey", "o_orderpriority"), "o_orderkey", work.at("pool"))
    _sorted_lines(scores, "l_orderkey", work.at("scores"))
    left = files.jsonl_numbered(spark, work.at("pool"), "o_orderkey long, o_orderpriority string")
    return files.zipped(left, files.jsonl_numbered(spark, work.at("scores"), "c long, n long"))


_REASON = "CASE WHEN event_type = 'error' THEN 'error event' WHEN value IS NULL THEN 'no value' WHEN value > 100 THEN 'too large' END"


@query(f"""WITH e AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts, user_id, event_type, value) = 1)
SELECT event_id, user_id, {_REASON} AS reject_reason FROM e""")
def resumable_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events in a ledger of accepted and rejected rows, each once though the stream is started twice and a batch is offered again."""
    work, events = Workspace(spark, "ledger"), load(spark, sf_dir, "events")
    events.select("event_id", "ts", "user_id", "event_type", "value").repartition(4, "event_id").write.parquet(work.at("landed"))
    sink, rules = Ledger(spark, work.at("sink")), Rules("event_id", ("ts", "user_id", "event_type", "value"), F.expr(_REASON))
    landed = spark.read.parquet(work.at("landed"))
    for _ in range(2):
        stream = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 2).parquet(work.at("landed"))
        stream_into(stream, sink, rules, work.at("checkpoint")).awaitTermination()
    sink.append(landed, 0, rules)
    sink.append(landed, 10**6, rules)  # another batch with nothing new
    sink.compact()
    kept, rejected = sink.read(), sink.read("rejected")
    return kept.select("event_id", "user_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(rejected.select("event_id", "user_id", "reject_reason"))


@query("""WITH a AS (SELECT p_partkey AS k, false AS bad, 'parts' AS source FROM part UNION ALL SELECT s_suppkey, s_acctbal = (SELECT min(s_acctbal) FROM supplier), 'suppliers' FROM supplier)
SELECT source, k, bad AS quarantined FROM a""")
def isolated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of which one cannot be planned and one fails on some rows: the rows of the others, and those that failed."""
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    supplier = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    supplier = supplier.join(F.broadcast(supplier.agg(F.min("v").alias("low"))))  # one row
    whole = lambda df: (df.select("k", F.lit("parts").alias("source")), df)
    strict = lambda df: (df.where(F.assert_true(F.col("v") > F.col("low"), "not above the lowest").isNull()).select("k", F.lit("suppliers").alias("source")), df)
    broken = lambda df: (df.select("no_such_column"), df)
    found = loaders.load_isolated({"parts": parts, "broken": parts, "suppliers": supplier}, {"parts": whole, "broken": broken, "suppliers": strict})
    if list(found.failed) != ["broken"]:
        raise ValueError(f"unexpected failures: {found.failed}")
    bad = found.quarantine.select("source", F.get_json_object("row", "$.k").cast("long").alias("k"), F.lit(True).alias("quarantined"))
    return found.examples.select("source", F.col("k").cast("long").alias("k"), F.lit(False).alias("quarantined")).unionByName(bad)


@query("""WITH t AS (SELECT doc_id, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS tokens FROM documents), k AS (SELECT *, row_number() OVER w AS place, sum(tokens) OVER w AS upto FROM t WHERE tokens <= 1500
 WINDOW w AS (ORDER BY md5('17|' || doc_id), doc_id ROWS UNBOUNDED PRECEDING)) SELECT doc_id, tokens, place, upto::BIGINT AS upto FROM k WHERE upto <= (SELECT sum(tokens) FROM t) // 3""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn documents of at most 1500 tokens up to a third of all tokens, as lengths stand for them."""
    size = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).cast("long")
    d = load(spark, sf_dir, "documents").select("doc_id", size.alias("size"))
    total = d.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    kept, _ = gates.token_gate(d, F.col("size"), [rows.hash_order(17, "doc_id"), F.col("doc_id")], 1500, budget=total // 3)
    return kept.select("doc_id", "tokens", "place", "upto")


def tokenizer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents of at most 4096 tokens of a byte-level tokenizer, half a million tokens in all.

    SQL has no tokenizer; tests compare it with the library."""
    import public_tokenizers

    definition = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    d = load(spark, sf_dir, "documents").select("doc_id", tokens.token_count(F.col("text"), definition).alias("n"))  # no text is dealt or written
    kept, _ = gates.token_gate(d, F.col("n"), [F.col("doc_id")], 4096, budget=500_000)
    return kept.select("doc_id", "tokens", "place", "upto")


QUERIES["tokenizer_gate"] = tokenizer_gate


_DETAILS = "md5(string_agg(coalesce(b, '-') || ':' || coalesce(equal, false), ' ' ORDER BY i))"


@query(f"""WITH {_GENERATED}, {_graded_sql('b')}, d AS (SELECT o_orderkey, any_value(r) AS reference, count(*) AS n, count_if(coalesce(equal, false))::BIGINT AS c, {_DETAILS} AS details
 FROM box LEFT JOIN eq ON id = o_orderkey * 4 + i GROUP BY o_orderkey), m AS (SELECT count(*) AS n_problems, round(avg(c / n::DOUBLE), 6) AS pass_1 FROM d)
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS index, md5('Order ' || o_orderkey) AS prompt, reference, n, c, details, n_problems, pass_1 FROM d, m""")
def scored_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of generations scored: every row's extracted answers and whether they are right, and the file's metrics."""
    work = Workspace(spark, "scored")
    orders = _sorted(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")  # texts are made behind the exchange, once
    g = responded(orders).withColumnRenamed("texts", "completions")
    even = F.col("o_orderkey") % 2 == 0  # half of the rows have an answer that the reference overrides, half only an answer
    g = g.select("o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("prompt"), F.when(even, F.col("r")).alias("reference"), F.when(even, "other").otherwise(F.col("r")).alias("answer"), "completions")
    g.write.json(work.at("generations"))
    items = files.jsonl_numbered(spark, work.at("generations"), "prompt string, reference string, answer string, completions array<string>")
    details, metrics = scoring.score_file(items.withColumn("index", F.col("row_no") - 1), "boxed")
    shown = F.array_join(F.transform("completions", lambda x: F.concat(F.coalesce(x["extracted"], F.lit("-")), F.lit(":"), x["correct"].cast("string"))), " ")
    out = details.crossJoin(F.broadcast(metrics.select("n_problems", F.round("pass_1", 6).alias("pass_1"))))  # one row
    return out.select("index", F.md5("prompt").alias("prompt"), "reference", "n", "c", F.md5(shown).alias("details"), "n_problems", "pass_1")


_TRACES = f"""{_COMP}, r AS (SELECT qid, attempt, trim(regexp_replace(text, '</think>.*', '', 's')) AS thinking, coalesce(letter = gold, false) AS ok, gold FROM comp WHERE gold <> 'C'),
t AS (SELECT qid, count(*) AS n_samples, any_value(gold) AS gold, arg_min(thinking, length(thinking) * 10 + attempt) FILTER (ok AND length(thinking) <= 20) AS thinking FROM r GROUP BY qid),
f AS (SELECT o_orderkey AS qid, o_orderkey % 11 = 0 AS no_user, t.* EXCLUDE (qid) FROM orders LEFT JOIN t ON qid = o_orderkey),
w AS (SELECT *, CASE WHEN n_samples IS NULL THEN 'passthrough' WHEN thinking IS NOT NULL AND NOT no_user THEN 'replaced' WHEN thinking IS NOT NULL THEN 'dropped' ELSE 'fallback' END AS route FROM f)"""


def _assembled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("o_orderkey").cast("string")
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    first = F.when(F.col("o_orderkey") % 11 == 0, "system").otherwise("user")
    told = F.array(F.struct(first.alias("role"), F.concat(F.lit("Order "), key).alias("content")), turn("assistant", F.lit("as it was")))
    given = load(spark, sf_dir, "orders").select(key.alias("uid"), told.alias("messages"), F.lit("source").alias("cot_source"), F.char(65 + F.col("o_orderkey") % 4).alias("gold_letter"), "o_orderpriority")
    samples = completions(spark, sf_dir).where("gold <> 'C'").select(F.col("qid").cast("string").alias("uid"), "attempt", F.col("text").alias("completion"), "gold")
    return assembly.assemble(given, samples, "distilled", filtered=True, shortest=True, most_chars=20)


@query(f"""WITH {_TRACES} SELECT qid, route, coalesce(n_samples, 0) AS n_samples, CASE WHEN route = 'replaced' THEN 'distilled' ELSE 'source' END AS cot_source,
 md5(CASE WHEN no_user THEN 'system' ELSE 'user' END || 'Order ' || qid || 'assistant' || CASE WHEN route = 'replaced' THEN '<think>' || chr(10) || thinking || chr(10) || '</think>' || chr(10) || chr(10)
 || 'The answer is ' || chr(92) || 'boxed{{' || gold || '}}' ELSE 'as it was' END) AS messages FROM w""")
def assembled_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next corpus: each row's route, and its messages with the shortest clean right trace."""
    out, _ = _assembled(spark, sf_dir)
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], m["content"])), "")
    return out.select(F.col("uid").cast("long").alias("qid"), "route", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), "cot_source", F.md5(flat).alias("messages"))


@query(f"""WITH {_TRACES}, c AS (SELECT o_orderpriority, count(n_samples) AS in_scope, {', '.join(f"count_if(route = '{r}')::BIGINT AS {r}" for r in ('replaced', 'fallback', 'passthrough', 'dropped'))},
 count_if(route <> 'dropped')::BIGINT AS kept, (SELECT count(*) FROM w z WHERE z.n_samples IS NOT NULL AND z.thinking IS NULL) AS logged FROM w JOIN orders ON o_orderkey = qid GROUP BY o_orderpriority)
SELECT *, round(100.0::DOUBLE * kept / greatest(in_scope, 1), 2) AS kept_pct, round(100.0::DOUBLE * replaced / greatest(in_scope, 1), 2) AS replaced_pct FROM c""")
def assembly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the rows by priority, and how many went to the log."""
    out, log = _assembled(spark, sf_dir)
    return assembly.assembly_report(out, "o_orderpriority").crossJoin(F.broadcast(log.agg(F.count(F.lit(1)).alias("logged"))))  # one row


_RECIPE = [("src1", 40), ("src2", 30), ("src3", 20), ("src4", 1000)]


def _recipe_sql() -> str:
    """Pools in turn: keys of the blocklist and of earlier pools are seen."""
    out = [f"d AS (SELECT doc_id, coalesce(lang, '') AS lang, source, {_UID} AS uid FROM documents)", f"seen0 AS (SELECT {_UID} AS uid FROM benchmark UNION SELECT uid FROM d WHERE source = 'src0')"]
    for i, (name, wanted) in enumerate(_RECIPE):
        out.append(f"p{i} AS (SELECT uid, lang, doc_id, '{name}' AS part FROM d WHERE source = '{name}' AND uid NOT IN (SELECT uid FROM seen{i}) QUALIFY row_number() OVER (PARTITION BY uid ORDER BY doc_id) = 1)")
        out.append(f"q{i} AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('9|' || doc_id), doc_id) AS turn FROM p{i} QUALIFY true)")
        out.append(f"k{i} AS (SELECT part, uid, lang, doc_id FROM q{i} ORDER BY turn, lang LIMIT {wanted})")
        out.append(f"seen{i + 1} AS (SELECT uid FROM seen{i} UNION SELECT uid FROM d WHERE source = '{name}')")
    return "WITH " + ", ".join(out).replace(" QUALIFY true", "") + " " + " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(_RECIPE)))


@query(_recipe_sql())
def dev_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A development set by a recipe of sources and numbers: no text that is trained on or in an earlier source, languages in turn."""
    d = load(spark, sf_dir, "documents").select(text.stable_uid(F.col("text")).alias("uid"), F.coalesce("lang", F.lit("")).alias("lang"), "doc_id", "source")
    d = Workspace(spark, "recipe").save(d, "keys")
    block = load(spark, sf_dir, "benchmark").select(text.stable_uid(F.col("text")).alias("uid")).unionByName(d.where("source = 'src0'").select("uid"))
    pools = [(name, d.where(F.col("source") == name).drop("source"), wanted) for name, wanted in _RECIPE]
    return rows.recipe(pools, "uid", "lang", block, 9, "doc_id").select("part", "uid", "lang", "doc_id")


_CLEAN_TRIVIA = _TRIVIA.replace(f"{_FORM} AS gold", f"trim({_FORM}) AS gold")


@query(f"""WITH {_CLEAN_TRIVIA}, pk AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY x) AS place, trim(x.option) AS option FROM md QUALIFY place <= 3),
mm AS (SELECT qid, list(option ORDER BY place) AS m FROM pk GROUP BY qid HAVING count(*) = 3), op AS (SELECT qid, gold, {_shuffle_sql('list_concat([gold], m)', 21)} AS options FROM qs JOIN mm USING (qid))
SELECT 'Q' || qid AS question, array_to_string(options, '|') AS options, (list_position(options, gold) - 1)::INT AS gold_idx, 'history_geo' AS macro_cat, true AS good FROM op
UNION ALL SELECT 'Q' || qid, '', -1, '', false FROM x WHERE qid NOT IN (SELECT qid FROM op)""")
def load_trivia_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free answers as questions of four options, and the records that were rejected."""
    raw = load(spark, sf_dir, "part").selectExpr(
        "p_partkey AS question_id", "' Q' || p_partkey || ' ' AS question", f"named_struct('value', {_FORM}, 'aliases', array(p_brand, lower(p_name))) AS answer"
    )
    good, bad = loaders.triviaqa(raw, 21)
    shown = good.select("question", F.array_join("options", "|").alias("options"), "gold_idx", "macro_cat", F.lit(True).alias("good"))
    rejected = bad.select(F.trim("question").alias("question"), F.lit("").alias("options"), F.lit(-1).alias("gold_idx"), F.lit("").alias("macro_cat"), F.lit(False).alias("good"))
    return shown.unionByName(rejected)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS name, false AS rejected FROM customer WHERE c_custkey % 5 > 0 UNION ALL
SELECT -1, '{"c_custkey":' || c_custkey || ',"na', true FROM customer WHERE c_custkey % 5 = 0""")
def lenient_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which a fifth break off: the whole ones as rows, the others as they are; what was written of the rows is read strictly again."""
    work, c = Workspace(spark, "lenient"), load(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 7 > 0, F.col("c_name"))
    line = F.when(F.col("c_custkey") % 5 > 0, F.to_json(F.struct("c_custkey", name.alias("name")))).otherwise(F.concat(F.lit('{"c_custkey":'), F.col("c_custkey").cast("string"), F.lit(',"na')))
    c.select(line.alias("value")).write.text(work.at("lines"))
    schema = "c_custkey long, name string"
    good, bad = files.jsonl_lenient(spark, work.at("lines"), schema)
    files.write_jsonl(good, work.at("good"))
    again = files.jsonl_strict(spark, work.at("good"), schema)
    return again.withColumn("rejected", F.lit(False)).unionByName(bad.select(F.lit(-1).cast("long").alias("c_custkey"), F.col("value").alias("name"), F.lit(True).alias("rejected")))


@query("""WITH q AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS category, p_size % 20 AS a FROM part) SELECT id, category, substr('ABCDEFGHIJKLMNOPQRST', a + 1, 1) AS answer FROM q""")
def keyed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in a file by category with their answers from a second file, an object keyed by id."""
    work, p = Workspace(spark, "keyed"), load(spark, sf_dir, "part")
    category = F.when(F.col("p_size") % 3 == 0, "small").when(F.col("p_size") % 3 == 1, "medium").otherwise("large")
    lists = p.groupBy(category.alias("category"), F.pmod(F.xxhash64("p_partkey"), F.lit(16))).agg(F.collect_list(F.struct(F.col("p_partkey").alias("id"))).alias("items"))
    lists.select(F.create_map("category", "items").alias("items")).write.json(work.at("lists"))
    p.select(F.to_json(F.create_map(F.col("p_partkey").cast("string"), F.struct((F.col("p_size") % 20).alias("answer")))).alias("value")).write.text(work.at("answers"))
    lists = files.jsonl_strict(spark, work.at("lists"), "items map<string, array<struct<id: long>>>")
    questions = files.unpivot_categories(lists, "items").select("item.id", "category")
    told = spark.read.text(work.at("answers")).select(F.explode(F.from_json("value", "map<string, struct<answer: int>>")).alias("id", "v")).select("id", "v.answer")
    return files.with_answers(questions, told)


@query("""WITH r AS (SELECT 'run' || o_orderkey % 3 AS run, (50 * (1 + o_orderkey % 2))::VARCHAR AS step, count(*) AS n, count_if(o_orderstatus = 'F')::BIGINT AS c, count_if(o_orderstatus <> 'O')::BIGINT AS boxed FROM orders GROUP BY 1, 2)
SELECT run, step, n AS n_problems, round(c / n::DOUBLE, 6) AS pass_1, round(boxed / n::DOUBLE, 6) AS box_compliance FROM r""")
def scored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored files found below a folder, runs and checkpoints told by their paths; box rates from the details where the metrics lack them."""
    work = Workspace(spark, "runs")
    o = load(spark, sf_dir, "orders").select(
        F.concat(F.lit("run"), (F.col("o_orderkey") % 3).cast("string")).alias("run"), (50 * (1 + F.col("o_orderkey") % 2)).cast("string").alias("step"),
        (F.col("o_orderstatus") == "F").cast("long").alias("c"), (F.col("o_orderstatus") != "O").cast("long").alias("boxed"),
    )
    whole = F.array(F.struct(F.lit("A").alias("extracted"), (F.col("c") == 1).alias("correct"), (F.col("boxed") == 1).alias("boxed")))
    detail = F.struct(F.lit(1).cast("long").alias("n"), "c", "boxed", whole.alias("completions"))
    rate = F.create_map(F.lit("pass@1"), F.sum("c") / F.count(F.lit(1)))
    with_rate = F.map_concat(rate, F.create_map(F.lit("box_compliance"), F.sum("boxed") / F.count(F.lit(1))))
    made = o.groupBy("run", "step").agg(
        F.lit("boxed").alias("benchmark_method"), F.count(F.lit(1)).alias("n_problems"), F.lit(1).cast("long").alias("n_completions"),
        F.when(F.col("step") == "50", rate).otherwise(with_rate).alias("metrics"), F.collect_list(detail).alias("detailed_results"),
    )
    named = made.withColumn("name", F.concat(F.col("run"), F.lit("/checkpoint-"), F.col("step"))).drop("run", "step")
    named.repartition("name").write.partitionBy("name").json(work.at("runs"))
    scored = files.scored_metrics(spark, f"{work.at('runs')}/*/*.json")
    path = F.url_decode("file")
    found = scored.select(F.regexp_extract(path, r"/name=(run\d+)(%2F|/)checkpoint-(\d+)/", 1).alias("run"), F.regexp_extract(path, r"/name=(run\d+)(%2F|/)checkpoint-(\d+)/", 3).alias("step"), "n_problems", "metrics", "box_compliance")
    return found.select("run", "step", "n_problems", F.round(F.element_at("metrics", "pass@1"), 6).alias("pass_1"), F.round("box_compliance", 6).alias("box_compliance"))


@query("SELECT s_nationkey::VARCHAR AS nation, count(*)::VARCHAR AS n, 'csv' AS kind FROM supplier GROUP BY 1 UNION ALL SELECT s_nationkey::VARCHAR, count(*)::VARCHAR, 'report' FROM supplier GROUP BY 1 UNION ALL SELECT s_nationkey::VARCHAR, (2 * count(*))::VARCHAR, 'chunks' FROM supplier GROUP BY 1")
def written_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts a nation as a CSV file, as a section of a JSON report, and of rows in chunks of which one was written twice."""
    work, s = Workspace(spark, "reports"), load(spark, sf_dir, "supplier")
    per = s.groupBy(F.col("s_nationkey").cast("string").alias("nation")).agg(F.count(F.lit(1)).cast("string").alias("n"))
    files.write_csv(per, work.at("csv"), ["nation", "n"])
    files.write_report(spark, {"nations": per}, work.at("report"))
    chunked = s.select("s_suppkey", "s_nationkey", (F.col("s_nationkey") % 4).alias("chunk"))
    files.write_chunks(chunked, work.at("chunks"), "chunk")
    files.write_chunks(chunked.where("chunk = 2").limit(1), work.at("chunks"), "chunk")  # a chunk that broke off
    files.write_chunks(chunked.where("chunk = 2"), work.at("chunks"), "chunk")  # replaces its own rows only
    files.write_split(chunked.withColumn("split", F.lit("all")), work.at("split"))
    csv = spark.read.option("header", True).csv(work.at("csv")).withColumn("kind", F.lit("csv"))
    section = spark.read.text(work.at("report"), wholetext=True).select(F.explode(F.from_json("value", "nations array<struct<nation: string, n: string>>").nations).alias("x"))
    both = spark.read.parquet(work.at("chunks")).select("s_nationkey").unionByName(spark.read.parquet(work.at("split")).select("s_nationkey"))
    chunks = both.groupBy(F.col("s_nationkey").cast("string").alias("nation")).agg(F.count(F.lit(1)).cast("string").alias("n"))
    return csv.unionByName(section.select("x.*", F.lit("report").alias("kind"))).unionByName(chunks.withColumn("kind", F.lit("chunks")))
