"""Registered queries of answer equivalence and scoring; registers with the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import answers, equivalence, fixed, text
from loomwork.operators import scoring
from loomwork.plans.bindings import load
from loomwork.plans.catalog import query
from loomwork.plans.responses import _COMP, completions
from loomwork.workspace import Workspace


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Forms of an answer with the numbers v and w; a form is a list of literals and numbers.
FORMS = [
    ["\\frac{", "v", "}{", "w", "}"], ["v", "/", "w"], ["\\dfrac{", "v", "}{", "w", "}"], ["\\frac", "v", "w"],
    ["$\\tfrac{", "v", "}{", "w", "}$"], ["x=", "v", "/", "w"], ["v", ".00"], ["v"], ["v", ",000"], ["v", "000"],
    ["\\boxed{", "v", "}"], ["v", "\\text{ cm}"], ["\\left(", "v", ", ", "w", "\\right)"], ["(", "v", ",", "w", ")"],
    ["The final answer is ", "v", " units."], ["v", "^\\circ"], ["\\sqrt", "v"], ["\\sqrt{", "v", "}"], ["0.5"], [".5"],
    ["\\frac{1}{2}"], ["{", "v", "}"], ["v", " dollars and ", "w", " cents"], ["\\text{(", "v", ")}"], ["3j+", "v"], ["3i+", "v"],
]
_N = len(FORMS)


def _form_sql(which: str) -> str:
    part = lambda p: f"{p}::VARCHAR" if p in ("v", "w") else quote(p)
    cases = " ".join(f"WHEN {i} THEN " + " || ".join(map(part, form)) for i, form in enumerate(FORMS))
    return f"CASE {which} {cases} END"


def _form(which: Column) -> Column:
    part = lambda p: F.col(p).cast("string") if p in ("v", "w") else F.lit(p)
    out = F.lit(None)
    for i, form in enumerate(FORMS):
        out = F.when(which == i, F.concat(*map(part, form))).otherwise(out)
    return out


def answered(orders: DataFrame) -> DataFrame:
    """Each order's answer and reference, in forms and with numbers drawn from its key."""
    k = F.col("o_orderkey")
    o = orders.select("o_orderkey", "o_orderpriority", (k % 7 + 1).alias("v"), (F.floor(k / 7) % 3 + 2).alias("w"))
    return o.select("o_orderkey", "o_orderpriority", "v", _form(k % _N).alias("l"), _form(F.floor(k / _N) % _N).alias("r"))


def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``answered`` of the given orders."""
    return answered(load(spark, sf_dir, "orders"))


_ANSWERS = f"""pr AS (SELECT *, {_form_sql(f'o_orderkey % {_N}')} AS l, {_form_sql(f'(o_orderkey // {_N}) % {_N}')} AS r
 FROM (SELECT o_orderkey, o_orderpriority, o_orderkey % 7 + 1 AS v, (o_orderkey // 7) % 3 + 2 AS w FROM orders))"""


def _fold(rules: list[tuple[str, str]]) -> str:
    out = "x"
    for a, b in rules:
        out = f"replace({out}, {quote(a)}, {quote(b)})"
    return out


_TRIM = r"regexp_replace({}, '^[ \t-\r]+|[ \t-\r]+$', '', 'g')"
_FINAL_STEPS = [
    _fold(fixed.FINAL_REWRITES + [(x, "") for x in fixed.FINAL_DROPPED]),
    *(f"regexp_replace(x, {quote(w)}, '\\1', 'g')" for w in fixed.FINAL_WRAPPERS),
    *(f"coalesce(list_extract(regexp_extract_all(x, {quote(m)}, 1), -1), x)" for m in fixed.FINAL_MARKS),
    _TRIM.format("x"),
    r"CASE WHEN contains(x, '\frac') THEN x ELSE replace(x, 'rac', '\frac') END",
    r"replace(regexp_replace(regexp_replace(x, 'frac([^{])(.)', 'frac{\1}{\2}', 'g'), 'sqrt([^{])', 'sqrt{\1}', 'g'), '$', '')",
    "CASE WHEN regexp_full_match(replace(x, ',', ''), '[0-9]+') THEN replace(x, ',', '') ELSE x END",
]
_BRACED = r"""CASE WHEN starts_with(p, '{') THEN p ELSE '{' || p[1] || '}' || CASE WHEN p[2] = '{' THEN p[2] ELSE '{' || p[2] || '}' END || p[3:] END"""
_STRIP_STEPS = [
    f"regexp_replace(replace({_TRIM.format('x')}, chr(10), ''), '[.]+$', '')",
    _fold(fixed.STRIP_FIRST),
    r"coalesce(nullif(" + _TRIM.format(r"regexp_replace(x, '\\text\{.*?\}$', '')") + ", ''), x)",
    _fold(fixed.STRIP_THEN),
    r"CASE WHEN contains(x, '\infty') THEN x ELSE replace(x, 'inf', '\infty') END",
    _fold([("+\\inity", "\\infty"), ("and", ""), ("\\mathbf", "")]),
    r"replace(replace(regexp_replace(x, '\\mbox\{.*?\}', '', 'g'), '''', ''), '""', '')".replace('""', '"'),
    "CASE WHEN contains(x, 'i') THEN x ELSE replace(x, 'j', 'i') END",
    r"regexp_replace(regexp_replace(x, '([0-9]+)\.0+([^0-9])', '\1\2', 'g'), '([0-9]+)\.0+$', '\1')",
    "CASE WHEN starts_with(x, '.') THEN '0' || x ELSE x END",
    "CASE WHEN length(x) - length(replace(x, '=', '')) = 1 AND strpos(x, '=') <= 3 THEN string_split(x, '=')[2] ELSE x END",
    r"replace(regexp_replace(x, '\\sqrt([0-9A-Za-z_]+)', '\\sqrt{\1}', 'g'), ' ', '')",
    rf"""CASE WHEN len(list_filter(string_split(x, '\frac')[2:], lambda p: length(p) < 2 AND NOT starts_with(p, '{{'))) > 0 THEN x
      ELSE array_to_string(list_concat(string_split(x, '\frac')[1:1], list_transform(string_split(x, '\frac')[2:], lambda p: {_BRACED})), '\frac') END""",
    r"CASE WHEN x = '0.5' THEN '\frac{1}{2}' ELSE x END",
    r"regexp_replace(x, '^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$', '\\frac{\1}{\2}')",
]


def _steps(name: str, source: str, steps: list[str]) -> str:
    """Tables name0, name1, ..., each with one more step done to column x; the last is ``name``."""
    names = [f"{name}{i}" for i in range(len(steps) - 1)] + [name]
    return ",\n".join(f"{n} AS (SELECT * REPLACE ({e} AS x) FROM {s})" for n, e, s in zip(names, steps, [source, *names[:-1]], strict=True))


def _equal_sql(pairs: str) -> str:
    """Tables that end in ``eq`` (id, s, f, equal) of the table ``pairs`` (id, l, r)."""
    return f"""side AS (SELECT id, 0 AS a, l AS x FROM {pairs} UNION ALL SELECT id, 1, r FROM {pairs}),
{_steps('st', 'side', _STRIP_STEPS)},
{_steps('fs', 'st', _FINAL_STEPS)},
{_steps('ff', 'side', _FINAL_STEPS)},
forms AS (SELECT id, a, side.x AS raw, st.x AS s, fs.x AS fs, ff.x AS f FROM side JOIN st USING (id, a) JOIN fs USING (id, a) JOIN ff USING (id, a)),
eq AS (SELECT id, p.s, p.f, p.raw = q.raw OR p.s = q.s OR p.fs = q.fs OR p.f = q.f AS equal FROM forms p JOIN forms q USING (id) WHERE p.a = 0 AND q.a = 1)"""


@query(f"WITH {_ANSWERS}, pairs AS (SELECT o_orderkey AS id, l, r FROM pr), {_equal_sql('pairs')} SELECT id AS o_orderkey, s AS stripped, f AS final, equal FROM eq")
def math_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's answer in both normal forms, and whether it equals the reference."""
    p = answer_pairs(spark, sf_dir)
    return p.select(
        "o_orderkey", equivalence.stripped(F.col("l")).alias("stripped"), equivalence.final(F.col("l")).alias("final"),
        equivalence.is_equivalent(F.col("l"), F.col("r")).alias("equal"),
    )


#: The last box by depth-bounded braces, without a second pair of braces.
_BOX = r"""nullif(regexp_replace(regexp_extract(string_split({t}, CASE WHEN contains({t}, '\boxed') THEN '\boxed' ELSE '\fbox' END)[-1],
 '^(\{{(?:[^{{}}]|\{{(?:[^{{}}]|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*\}})*\}})', 1), '^\{{(.*)\}}$', '\1'), '')"""
_HAS_BOX = r"(contains({t}, '\boxed') OR contains({t}, '\fbox'))"
_GENERATED = f"""{_ANSWERS}, gen AS (SELECT o_orderkey, o_orderpriority, r, i, CASE i WHEN 0 THEN 'so {chr(92)}boxed{{' || l || '}}' WHEN 1 THEN l
 WHEN 2 THEN '{chr(92)}boxed{{{{' || r || '}}}}' ELSE 'x {chr(92)}fbox{{' || v || '}} or {chr(92)}boxed{{' || r END AS t FROM pr, range(4) x(i)),
box AS (SELECT *, CASE WHEN {_HAS_BOX.format(t='t')} THEN regexp_replace({_BOX.format(t='t')}, '^\\{{(.*)\\}}$', '\\1') END AS b FROM gen)"""


def responded(orders: DataFrame) -> DataFrame:
    """Four responses to each order's question in an array: the answer boxed, bare, the reference in two pairs of braces, an open box."""
    p = answered(orders)
    texts = F.array(
        F.concat(F.lit("so \\boxed{"), "l", F.lit("}")), F.col("l"), F.concat(F.lit("\\boxed{{"), "r", F.lit("}}")),
        F.concat(F.lit("x \\fbox{"), F.col("v").cast("string"), F.lit("} or \\boxed{"), "r"),
    )
    return p.select("o_orderkey", "o_orderpriority", "r", texts.alias("texts"))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``responded`` of the given orders, a row a response."""
    return responded(load(spark, sf_dir, "orders")).select("o_orderkey", "o_orderpriority", "r", F.posexplode("texts").alias("i", "t"))


def _graded_sql(extracted: str) -> str:
    """Tables that end in ``eq`` for the extracted column against the reference, both in final form first."""
    return f"""nn AS (SELECT o_orderkey * 4 + i AS id, {extracted} AS x, r, o_orderkey FROM box WHERE {extracted} IS NOT NULL),
{_steps('nf', 'nn', _FINAL_STEPS)},
ref AS (SELECT id, r AS x FROM nn), {_steps('nr', 'ref', _FINAL_STEPS)},
pairs AS (SELECT id, nf.x AS l, nr.x AS r FROM nf JOIN nr USING (id)), {_equal_sql('pairs')}"""


@query(f"""WITH {_GENERATED}, {_graded_sql('b')}
SELECT o_orderkey, count(*) AS n, count_if(coalesce(equal, false))::BIGINT AS c, count(b) AS boxed FROM box LEFT JOIN eq ON id = o_orderkey * 4 + i GROUP BY o_orderkey""")
def score_math_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right and boxed responses to each question, by mathematical equality."""
    g = generated(spark, sf_dir).select("o_orderkey", "r", answers.extract(F.col("t"), F.col("r"), "boxed").alias("x"))
    g = scoring.graded(Workspace(spark, "math").save(g, "found"), "x", "r", "boxed")
    return g.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("c"), F.count("x").alias("boxed"))


@query(rf"""WITH {_GENERATED}, e AS (SELECT *, {_TRIM.format('t')} AS whole FROM box)
SELECT o_orderkey, i::INT AS i, b AS by_box, whole AS by_text, coalesce(b, whole) AS by_either, regexp_replace(coalesce(b, whole),
 '(?i)^(the\s+)?(final\s+)?answer\s*(is|:)\s*', '') AS by_knowledge FROM e""")
def extract_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each method takes from each response (the reference is no letter here)."""
    reference = F.lit("many words")
    get = lambda m: answers.extract(F.col("t"), reference, m)
    return generated(spark, sf_dir).select(
        "o_orderkey", "i", get("boxed").alias("by_box"), get("exact").alias("by_text"), get("either").alias("by_either"),
        get("knowledge").alias("by_knowledge"),
    )


@query(rf"""WITH {_COMP}, f AS (SELECT qid, attempt, {_BOX.format(t='text')} AS b, {_HAS_BOX.format(t='text')} AS any_box, text, gold FROM comp)
SELECT gold, round(count_if(any_box AND b IS NOT NULL) / count(*)::DOUBLE, 6) AS extracted, round(100.0::DOUBLE * count_if(any_box AND b <> '') / count(*), 6) AS filled_pct,
 round(count_if(contains(text, '\boxed{{')) / count(*)::DOUBLE, 6) AS marked FROM f GROUP BY gold""")
def format_compliance_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of a response being boxed: an answer extracted, one that is not empty, the mark anywhere."""
    c = completions(spark, sf_dir).withColumn("b", answers.boxed_answer(F.col("text")))
    return c.groupBy("gold").agg(*(F.round(e, 6).alias(n) for n, e in scoring.compliance(F.col("b"), F.col("text")).items()))


@query(rf"""WITH {_COMP} SELECT qid, attempt, nullif(regexp_extract(text, '\\boxed\{{([A-Z])\}}', 1), '') AS first_letter,
 upper(list_extract(regexp_extract_all(text, '\\boxed\{{([A-Za-z])\}}', 1), -1)) AS last_letter,
 list_extract(regexp_extract_all(text, '\\boxed\{{([^}}]*)\}}', 1), 1) AS first_box,
 CASE WHEN contains(text, '\boxed{{') THEN nullif(regexp_replace(regexp_extract('{{' || string_split(text, '\boxed{{')[-1], '^(\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})', 1), '^\{{(.*)\}}$', '\1'), '') END AS own_box FROM comp""")
def simple_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four plainer readings of a response's boxes."""
    t = F.col("text")
    return completions(spark, sf_dir).select(
        "qid", "attempt", answers.first_letter_box(t).alias("first_letter"), answers.last_letter_box(t).alias("last_letter"),
        answers.first_box(t).alias("first_box"), answers.own_box(t).alias("own_box"),
    )


@query(f"""WITH {_COMP}, s AS (SELECT CASE WHEN NOT contains(text, '</think>') THEN 'truncated_no_close' WHEN letter IS NULL THEN 'no_answer'
 WHEN letter <> gold THEN 'wrong_answer' ELSE 'correct' END AS status FROM comp)
SELECT status, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM s), 6) AS pct FROM s GROUP BY status""")
def extraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How responses end: cut off, without an answer, wrong or right, with shares."""
    c = completions(spark, sf_dir).withColumn("status", scoring.status(F.col("text"), F.col("letter"), F.col("gold")))
    return scoring.shares(c, "status")


@query(f"""WITH {_COMP}, s AS (SELECT CASE qid % 3 WHEN 0 THEN 'it' WHEN 1 THEN 'zh' ELSE 'ru' END AS lang, gold AS subject, coalesce(letter = gold, false) AS ok FROM comp)
SELECT CASE WHEN lang IS NULL THEN 'subject' ELSE 'language' END AS section, coalesce(lang, subject) AS key, count_if(ok)::BIGINT AS correct, count(*) AS total,
 round(100.0::DOUBLE * count_if(ok) / count(*), 6) AS accuracy_pct FROM s GROUP BY GROUPING SETS ((lang), (subject))""")
def pooled_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over all responses by language and by subject, one report."""
    lang = F.element_at(F.array(F.lit("it"), F.lit("zh"), F.lit("ru")), (F.col("qid") % 3 + 1).cast("int"))
    c = completions(spark, sf_dir).select(lang.alias("language"), F.col("gold").alias("subject"), "right")
    return scoring.pooled(c, ["language", "subject"], "right")


@query(f"""WITH {_COMP}, p AS (SELECT qid, any_value(gold) AS category, count_if(coalesce(letter = gold, false)) AS c, bool_or(attempt = 0 AND letter IS NULL) AS first_none FROM comp GROUP BY qid)
SELECT category, sum(c)::BIGINT AS correct, count(*) AS total, round(sum(c) / count(*)::DOUBLE, 6) AS ratio, count_if(first_none)::BIGINT AS no_format, sum(c) / count(*)::DOUBLE < 0.8 AS weak
FROM p GROUP BY category""")
def category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right responses a problem by category; only a problem's first response counts as unformatted.

    With more than one response a problem the ratio can pass 1, as it does where it is from."""
    return scoring.breakdown(completions(spark, sf_dir), "qid", "gold", F.col("right"), F.col("letter").isNotNull())


_LEVELS = "(SELECT *, CASE WHEN qid % 11 = 0 THEN NULL WHEN qid % 11 = 1 THEN '' ELSE gold END AS category, CASE WHEN qid % 5 > 0 THEN 'Level ' || (qid % 5) END AS level FROM comp)"
_PASS8 = "CASE WHEN c = 0 THEN 0.0 ELSE 1.0 END"


@query(f"""WITH {_COMP}, p AS (SELECT qid, coalesce(nullif(category, ''), 'uncategorized') AS category, coalesce(nullif(level, ''), 'unleveled') AS level,
 count(*) AS n, count_if(coalesce(letter = gold, false)) AS c, count(letter) AS b FROM {_LEVELS} GROUP BY ALL)
SELECT CASE WHEN level IS NULL THEN 'category' ELSE 'level' END AS section, coalesce(category, level) AS key, count(*) AS problems, round(avg(c / n::DOUBLE), 6) AS pass_1,
 round(avg({_PASS8}), 6) AS pass_8, round(sum(b) / sum(n)::DOUBLE, 6) AS box_rate FROM p GROUP BY GROUPING SETS ((category), (level))""")
def category_level_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pass@1, pass@8 and box rate by category and by level; blank ones under names of their own."""
    k = F.col("qid")
    c = completions(spark, sf_dir).withColumns({
        "category": F.when(k % 11 == 0, None).when(k % 11 == 1, "").otherwise(F.col("gold")),
        "level": F.when(k % 5 > 0, F.concat(F.lit("Level "), (k % 5).cast("string"))),
    })
    named = {"category": "uncategorized", "level": "unleveled"}
    return scoring.level_report(c, "qid", named, F.col("right"), F.col("letter").isNotNull())


@query("""WITH d AS (SELECT o_orderkey AS idx, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 9 END AS boxed, [o_orderkey % 2 = 0, NULL, o_orderkey % 5 = 0] AS flags,
 [CASE WHEN o_orderkey % 3 = 0 THEN 'x' END, 'y', ''] AS extracted, o_orderkey % 4 = 3 AS bare FROM orders)
SELECT idx, CASE WHEN boxed IS NOT NULL THEN boxed WHEN NOT bare THEN list_sum(list_transform(range(1, 4), lambda i: CASE WHEN flags[i] IS NOT NULL THEN flags[i]::INT ELSE (extracted[i] IS NOT NULL)::INT END)) END::DOUBLE AS boxed FROM d""")
def boxed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A problem's boxed responses: the stored count, else each response's flag, else whether it was extracted."""
    k = F.col("o_orderkey")
    x = F.array(
        F.struct((k % 2 == 0).alias("boxed"), F.when(k % 3 == 0, "x").alias("extracted")),
        F.struct(F.lit(None).cast("boolean").alias("boxed"), F.lit("y").alias("extracted")),
        F.struct((k % 5 == 0).alias("boxed"), F.lit("").alias("extracted")),
    )
    d = load(spark, sf_dir, "orders").select(k.alias("idx"), F.when(k % 4 == 0, k % 9).alias("boxed"), F.when(k % 4 != 3, x).alias("completions"))
    return d.select("idx", scoring.boxed_count(F.col("boxed"), F.col("completions")).cast("double").alias("boxed"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM orders""")
def strict_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 where the last box equals the answer character by character, else 0: no normal form."""
    k = F.col("o_orderkey")
    shown = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".0"))).otherwise(F.lit(" "))
    t = F.concat(F.lit("\\boxed{1} \\boxed{"), shown, F.lit("}"))
    return load(spark, sf_dir, "orders").select(k, scoring.binary_reward(answers.boxed(t), k.cast("string")).alias("reward"))


_T13 = r"""'<THINK>a' || chr(10) || 'b</think> ' || CASE o_orderkey % 4 WHEN 0 THEN 'Justification: ' WHEN 1 THEN 'Answer - ' WHEN 2 THEN 'reasoning :' ELSE 'Explanation' END
 || 'x' || o_orderkey || chr(10) || chr(10) || chr(10) || chr(10) || 'y  '"""


@query(rf"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN '' ELSE 'Explanation' END || 'x' || o_orderkey || chr(10) || chr(10) || 'y' AS cleaned FROM orders""")
def think_strip_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teacher output without its thinking, label and blank lines."""
    k = F.col("o_orderkey")
    label = F.element_at(F.array(*map(F.lit, ("Justification: ", "Answer - ", "reasoning :", "Explanation"))), (k % 4 + 1).cast("int"))
    raw = F.concat(F.lit("<THINK>a\nb</think> "), label, F.lit("x"), k.cast("string"), F.lit("\n\n\n\ny  "))
    return load(spark, sf_dir, "orders").select(k, text.think_strip(raw).alias("cleaned"))
