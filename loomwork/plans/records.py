"""Registered queries of the record loaders over raw records made from parts; registers with the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import fixed
from loomwork.plans.bindings import load
from loomwork.plans.catalog import query
from loomwork.sources import loaders

_SUBJECTS = [s for names in fixed.MACRO_OF_SUBJECT.values() for s in names] + ["cooking", "Anatomy ", " SOCIOLOGY"]
_CATEGORIES = [s for names in fixed.MACRO_OF_CATEGORY.values() for s in names] + ["sports", "Law", " math "]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _map_sql(name: str, table: dict[str, list[str]]) -> str:
    return f"{name}(k, v) AS (VALUES " + ", ".join(f"('{s}', '{m}')" for m, names in table.items() for s in names) + ")"


_MAPS = f"{_map_sql('ms', fixed.MACRO_OF_SUBJECT)}, {_map_sql('mc', fixed.MACRO_OF_CATEGORY)}"
_UID = r"substr(sha256(regexp_replace(lower({0}), '[ \t-\r]+', ' ', 'g')), 1, 16)"
_Q = "CASE p_partkey % 17 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE ' Which ' || p_name || ' of ' || p_partkey || ' ' END"


def _raw(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return load(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in columns.items()))


def _pick(values: list[str]) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast(p_partkey % {len(values)} + 1 AS int))"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _flat(good: DataFrame) -> DataFrame:
    return good.select("source", "uid", "gold_idx", "macro_cat", "subject", F.array_join("options", "|").alias("options"))


_CHOICES = "list_transform(list_filter([' ' || p_name, p_brand, CASE WHEN p_partkey % 3 > 0 THEN p_type END, p_size::VARCHAR], lambda x: x IS NOT NULL), lambda x: trim(x))"


@query(f"""WITH {_MAPS}, r AS (SELECT p_partkey, trim({_Q}) AS q, {_CHOICES} AS o, CASE WHEN p_partkey % 13 > 0 THEN p_partkey % 5 END AS a,
 {_sql_list(_SUBJECTS)}[p_partkey % {len(_SUBJECTS)} + 1] AS s, {_sql_list(_CATEGORIES)}[p_partkey % {len(_CATEGORIES)} + 1] AS c FROM part),
e AS (SELECT 'mmlu' AS source, q, o, a, coalesce(v, 'commonsense') AS macro_cat, s AS subject FROM r LEFT JOIN ms ON k = lower(trim(s))
 UNION ALL SELECT 'mmlu_world', q, o, a, coalesce(v, 'commonsense'), s FROM r LEFT JOIN ms ON k = lower(trim(s)) WHERE list_contains({_sql_list(fixed.WORLD_SUBJECTS)}, s)
 UNION ALL SELECT 'mmlu_pro', q, o, coalesce(a, CASE WHEN p_partkey % 2 = 0 THEN 1 END), coalesce(v, 'commonsense'), c FROM r LEFT JOIN mc ON k = lower(trim(c)))
SELECT source, {_UID.format('q')} AS uid, a::INT AS gold_idx, macro_cat, subject, array_to_string(o, '|') AS options FROM e WHERE q <> '' AND a < len(o)""")
def load_choice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a list of choices and the gold's place."""
    choices = "array(' ' || p_name, p_brand, CASE WHEN p_partkey % 3 > 0 THEN p_type END, cast(p_size AS string))"
    place = "CASE WHEN p_partkey % 13 > 0 THEN p_partkey % 5 END"
    raw = _raw(spark, sf_dir, question=_Q, choices=choices, answer=place, subject=_pick(_SUBJECTS))
    pro = _raw(spark, sf_dir, question=_Q, options=choices, answer_index=place, answer="CASE WHEN p_partkey % 2 = 0 THEN ' b' ELSE 'none' END", category=_pick(_CATEGORIES))
    return _union([_flat(f(r)[0]) for f, r in ((loaders.mmlu, raw), (loaders.mmlu_world, raw), (loaders.mmlu_pro, pro))])


_KEYED = """SELECT '{0}' AS source, q, list_transform(list_sort(list_transform(range(1, 4), lambda i: [l[i], i::VARCHAR, t[i]])), lambda p: trim(p[3])) AS o,
 list_position(list_sort(l), {1}) - 1 AS a, '{2}' AS macro_cat, '{3}' AS subject FROM r WHERE p_partkey % 23 > 0 AND list_contains(l, {1})"""


@query(f"""WITH r AS (SELECT p_partkey, trim({_Q}) AS q, CASE p_partkey % 3 WHEN 0 THEN ['C', 'A', 'B'] WHEN 1 THEN ['10', '9', 'b'] ELSE ['A', 'B', 'C'] END AS l,
 [p_name, CASE WHEN p_partkey % 19 > 0 THEN p_brand ELSE ' ' END, p_type] AS t, CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'b' WHEN 2 THEN '10' WHEN 3 THEN 'C' ELSE 'A' END AS key FROM part),
e AS ({_KEYED.format('commonsenseqa', 'upper(key)', 'commonsense', 'commonsense')} UNION ALL
 SELECT * FROM ({_KEYED.format('arc_challenge', 'key', 'stem', 'arc_science')}) WHERE NOT list_contains(o, '') UNION ALL
 SELECT * FROM ({_KEYED.format('openbookqa', 'key', 'stem', 'openbookqa')}) WHERE NOT list_contains(o, '') UNION ALL
 SELECT 'ecqa', q, [p_name, upper(p_name), p_brand, p_type, 'x'], CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 4 END, 'commonsense', 'commonsense'
  FROM r JOIN part USING (p_partkey) WHERE p_partkey % 4 < 3 AND p_partkey % 29 > 0 UNION ALL
 SELECT 'socialiqa', CASE WHEN p_partkey % 5 > 0 THEN 'When ' || p_brand || chr(10) || chr(10) ELSE '' END || q, [p_name, p_brand, p_type], p_partkey % 5 - 1, 'commonsense', 'social_commonsense'
  FROM r JOIN part USING (p_partkey) WHERE p_partkey % 5 BETWEEN 1 AND 3 AND q <> '' UNION ALL
 SELECT 'boolq', CASE WHEN p_partkey % 2 = 0 THEN q || '?' ELSE q || '?' END, ['Yes', 'No'], CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END, 'commonsense', 'boolq' FROM r WHERE p_partkey % 11 > 0 AND q <> '')
SELECT source, {_UID.format('q')} AS uid, a::INT AS gold_idx, macro_cat, subject, array_to_string(o, '|') AS options FROM e WHERE q <> ''""")
def load_keyed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose gold is a label, a text, a number or a truth value."""
    labels = "CASE p_partkey % 3 WHEN 0 THEN array('C', 'A', 'B') WHEN 1 THEN array('10', '9', 'b') ELSE array('A', 'B', 'C') END"
    texts = "CASE WHEN p_partkey % 23 > 0 THEN array(p_name, CASE WHEN p_partkey % 19 > 0 THEN p_brand ELSE ' ' END, p_type) ELSE array(p_name) END"
    key = "CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ' b' WHEN 2 THEN '10' WHEN 3 THEN 'C' ELSE 'A ' END"
    keyed = _raw(spark, sf_dir, question=_Q, choices=f"named_struct('label', {labels}, 'text', {texts})", answerKey=key)
    answer = "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || ' ' WHEN 1 THEN lower(p_brand) WHEN 2 THEN 'X' ELSE 'neither' END"
    ops = {"q_op1": "p_name", "q_op2": "upper(p_name)", "q_op3": "p_brand", "q_op4": "CASE WHEN p_partkey % 29 > 0 THEN p_type END", "q_op5": "' x'"}
    free = _raw(spark, sf_dir, q_text=_Q, **ops, q_ans=answer, taskB="''")
    context = "CASE WHEN p_partkey % 5 > 0 THEN 'When ' || p_brand END"
    social = _raw(spark, sf_dir, context=context, question=_Q, answerA="p_name", answerB="p_brand", answerC="p_type", label="cast(p_partkey % 5 AS string)")
    asked = f"CASE WHEN p_partkey % 2 = 0 THEN {_Q} ELSE trim({_Q}) || '? ' END"
    yes = _raw(spark, sf_dir, question=f"CASE WHEN trim({_Q}) <> '' THEN {asked} END", answer="CASE WHEN p_partkey % 11 > 0 THEN p_partkey % 3 = 0 END")
    frames = [(loaders.commonsenseqa, keyed), (loaders.arc_challenge, keyed), (loaders.openbookqa, keyed), (loaders.ecqa, free), (loaders.socialiqa, social), (loaders.boolq, yes)]
    return _union([_flat(f(r)[0]) for f, r in frames])


@query(f"""WITH {_MAPS}, r AS (SELECT *, {_sql_list(_CATEGORIES)}[p_partkey % {len(_CATEGORIES)} + 1] AS c FROM part WHERE p_partkey % 9 > 0 AND p_partkey % 4 < 3)
SELECT 'mmlu_pro_cot' AS source, {_UID.format("'Which ' || p_partkey || '?' || chr(10) || 'See ' || p_brand || '.'")} AS uid, (p_partkey % 4)::INT AS gold_idx, coalesce(v, 'commonsense') AS macro_cat, c AS subject,
 p_name || ' and ' || p_size || '|' || p_type || '|last' AS options, CASE WHEN p_partkey % 5 > 0 THEN 'one' || chr(10) || p_brand END AS cot FROM r LEFT JOIN mc ON k = lower(trim(c))""")
def load_inline_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose options are lines of the question, wrapped ones among them."""
    lines = r"'Which ' || p_partkey || '?  \nSee ' || p_brand || '.\n\nA. ' || p_name || '  \n  and ' || p_size || '\n\n(b) B) ' "
    q = lines.replace(r"\n\n(b) B) ' ", r"\n\n B)  ' || p_type || '\r\nC. last '")
    q = f"CASE WHEN p_partkey % 9 > 0 THEN {q} ELSE 'no options' END"
    letter = "CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN ' B' WHEN 2 THEN 'C' ELSE 'K' END"
    steps = "CASE WHEN p_partkey % 5 > 0 THEN array(' one', NULL, p_brand) END"
    raw = _raw(spark, sf_dir, question=q, answer=letter, category=_pick(_CATEGORIES), chain_of_thoughts=steps)
    good, _ = loaders.mmlu_pro_cot(raw)
    return good.select("source", "uid", "gold_idx", "macro_cat", "subject", F.array_join("options", "|").alias("options"), "cot")


_DONE = "'<think>' || chr(10) || {0} || chr(10) || '</think>' || chr(10) || chr(10) || 'Therefore, the final answer is {b}boxed{{{{' || {1} || '}}}}.'".replace("{b}", chr(92))


@query(rf"""WITH e AS (SELECT 'competition' AS source, 'P ' || p_partkey AS prompt, '\frac{{' || p_size || '}}{{2}}' AS answer, {_DONE.format("'so ' || chr(92) || 'boxed{{1}} or ' || chr(92) || 'boxed{{ ' || chr(92) || 'frac{{' || p_size || '}}{{2}} }}'", "chr(92) || 'frac{{' || p_size || '}}{{2}}'")} AS completion, 'Level ' || p_size AS level FROM part WHERE p_partkey % 4 < 2
UNION ALL SELECT 'math500', CASE WHEN p_partkey % 10 > 0 THEN 'P ' || p_partkey ELSE 'None' END, p_size::VARCHAR, {_DONE.format('p_name', 'p_size')}, 'Level ' || p_size FROM part
UNION ALL SELECT 'instruct', 'P ' || p_partkey, p_brand, {_DONE.format('p_name', 'p_brand')}, CASE WHEN p_partkey % 2 = 0 THEN 'src' END FROM part
UNION ALL SELECT 'open_r1', 'P ' || p_partkey, p_brand, CASE p_partkey % 3 WHEN 1 THEN 'abc' ELSE 'zyx' END || chr(10) || chr(10) || 'Therefore, the final answer is \boxed{{' || p_brand || '}}.', 'algebra' FROM part WHERE p_partkey % 3 > 0)
SELECT source, prompt, answer, md5(completion) AS completion, level FROM e""".replace("{{", "{").replace("}}", "}"))
def load_math_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maths records with worked solutions."""
    sol = r"""CASE p_partkey % 4 WHEN 0 THEN ' so \\boxed{1} or \\boxed{ \\frac{' || p_size || '}{2} }' WHEN 1 THEN 'so \\boxed{1} or \\boxed{ \\frac{' || p_size || '}{2} } '
        WHEN 2 THEN 'none' ELSE 'x \\boxed{ }' END"""
    comp = _raw(spark, sf_dir, problem="' P ' || p_partkey", solution=sol, level="'Level ' || p_size", type="p_type")
    m500 = _raw(spark, sf_dir, problem="CASE WHEN p_partkey % 10 > 0 THEN 'P ' || p_partkey END", solution="p_name", answer="p_size", subject="p_type", level="'Level ' || p_size")
    inst = _raw(spark, sf_dir, problem="'P ' || p_partkey", generated_solution="p_name || ' '", expected_answer="p_brand", problem_source="CASE WHEN p_partkey % 2 = 0 THEN 'src' END")
    gens = "array('ab', 'abcd', ' abc', 'zyx', 'longer one', 'left over')"
    whole = "array(false, true, p_partkey % 3 = 1, p_partkey % 3 > 0, true)"
    right = "array(true, false, true, true, p_partkey % 3 > 0)"
    r1 = _raw(spark, sf_dir, problem="'P ' || p_partkey", answer="p_brand", generations="array('ab', 'abcd', 'abc', 'zyx', 'longer one', 'left over')", is_reasoning_complete=whole,
              correctness_math_verify=right, problem_type="'algebra'", question_type="'q'", source="'s'", uuid="p_partkey")
    parts = [(loaders.competition_math, comp, "competition", "level"), (loaders.math500, m500, "math500", "level"),
             (loaders.open_math_instruct, inst, "instruct", "problem_source"), (loaders.open_r1, r1, "open_r1", "problem_type")]
    return _union([
        f(r)[0].select(F.lit(n).alias("source"), "prompt", F.col("answer").cast("string"), F.md5("completion").alias("completion"), F.col(c).alias("level")) for f, r, n, c in parts
    ])


_BAD = "[" + ", ".join(f"'{b}'" for b in ["", *fixed.BAD_ANSWERS]) + "]"


@query(f"""WITH r AS (SELECT *, CASE p_partkey % 8 WHEN 0 THEN 'see ![](x) ' WHEN 1 THEN 'an <IMG src> ' WHEN 2 THEN 'an <image 3> ' WHEN 3 THEN 'imgs ' ELSE '' END || p_name || p_partkey AS p,
 CASE p_partkey % 11 WHEN 0 THEN 'Proof' WHEN 1 THEN ' N/A ' WHEN 2 THEN '' ELSE ' ' || p_size || ' ' END AS a FROM part),
e AS (SELECT 'numinamath_1_5' AS source, p, a, p_brand AS original_source FROM r WHERE p_partkey % 5 <> 2 AND p_partkey % 6 > 0
 UNION ALL SELECT 'nemotron_math_v2', p, a, CASE WHEN p_partkey % 2 = 0 THEN 'd' END FROM r WHERE p_partkey % 7 > 0 AND p_partkey % 9 > 0
 UNION ALL SELECT 'old', p, a, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'ps' END FROM r)
SELECT source, p AS prompt, trim(a) AS answer, original_source FROM e WHERE NOT list_contains({_BAD}, lower(trim(a))) AND NOT contains(p, '![](') AND NOT regexp_matches(p, '(?i)<im')""")
def load_prompt_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of three sources through the gate of bad answers, images, flags and tools."""
    p = "CASE p_partkey % 8 WHEN 0 THEN 'see ![](x) ' WHEN 1 THEN 'an <IMG src> ' WHEN 2 THEN 'an <image 3> ' WHEN 3 THEN 'imgs ' ELSE '' END || p_name || p_partkey"
    a = "CASE p_partkey % 11 WHEN 0 THEN 'Proof' WHEN 1 THEN ' N/A ' WHEN 2 THEN NULL ELSE ' ' || p_size || ' ' END"
    valid = "CASE p_partkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN NULL WHEN 2 THEN 'no' ELSE ' 1' END"
    nm = _raw(spark, sf_dir, problem=p, answer=a, problem_is_valid=valid, solution_is_valid="'true'", question_type="CASE WHEN p_partkey % 6 = 0 THEN 'Proof ' ELSE 'mcq' END",
              source="p_brand", problem_type="''", synthetic="true")
    ne = _raw(spark, sf_dir, problem=p, expected_answer=a, changed_answer_to_majority="CASE p_partkey % 7 WHEN 0 THEN true WHEN 1 THEN false END",
              tools="CASE p_partkey % 9 WHEN 0 THEN array('t') WHEN 1 THEN array() END", data_source="CASE WHEN p_partkey % 2 = 0 THEN 'd' ELSE '' END", uuid="'u'")
    old = _raw(spark, sf_dir, prompt=p, answer=a, source="CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN '' END", problem_source="CASE p_partkey % 3 WHEN 1 THEN 'ps' END",
               problem_type="''", type="'t'", level="'1'")
    frames = [loaders.numina_math(nm)[0], loaders.nemotron_math(ne)[0], loaders.existing_split(old, "old")[0]]
    return _union([f.select("source", "prompt", "answer", "original_source") for f in frames])


@query("""WITH e AS (SELECT 'xcopa' AS source, p_name || ' ' || CASE p_partkey % 2 WHEN 0 THEN 'Cause' ELSE 'Effect' END || ' ?' || chr(10) || chr(10) || 'A) ' || p_brand || chr(10) || 'B) ' || p_type AS prompt,
 CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE 'B' END AS answer, ['it', 'zh', 'xx'][p_partkey % 3 + 1] || '_' || p_partkey AS idx FROM part WHERE p_partkey % 3 < 2
UNION ALL SELECT 'mmmlu', prompt, min(answer), min(idx) FROM (SELECT p_name || chr(10) || chr(10) || 'A) ' || p_brand || chr(10) || 'B) b' || chr(10) || 'C) c' || chr(10) || 'D) ' || p_size AS prompt, 'C' AS answer, 'it_' || p_type || '_' || p_partkey AS idx FROM part) GROUP BY prompt
UNION ALL SELECT 'ru', p_name || chr(10) || chr(10) || 'A) a' || chr(10) || 'B) b' || chr(10) || 'C) ' || p_type || chr(10) || 'D) d', substr('ABCD', (p_partkey % 4 + 1)::INT, 1),
 'ru_' || p_brand || '_' || (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 3, p_partkey) - 1) FROM part
UNION ALL SELECT 'prox', p_name || chr(10) || chr(10) || 'A) x' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'B) ' || p_brand || chr(10) || 'C) ' || p_type ELSE chr(10) || 'B) ' || p_type END, 'J', 'hi_' || p_brand || '_' || p_partkey FROM part)
SELECT source, md5(prompt) AS prompt, answer, idx, split_part(idx, '_', 1) AS lang FROM e""")
def load_multilingual_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multilingual records as lettered prompts with an id that begins with the language."""
    xc = _raw(spark, sf_dir, premise="p_name", question="CASE p_partkey % 2 WHEN 0 THEN 'cause' ELSE 'eFFECT' END", choice1="p_brand", choice2="p_type", label="p_partkey % 3",
              idx="p_partkey", lang="element_at(array('it', 'zh', 'xx'), cast(p_partkey % 3 + 1 AS int))")
    mm = _raw(spark, sf_dir, Question="p_name", A="p_brand", B="'b'", C="'c'", D="cast(p_size AS string)", Answer="'C'", Subject="p_type", Language="'it'", n="p_partkey")
    ru = _raw(spark, sf_dir, question_ru="p_name", choices_ru="array('a', 'b', p_type, 'd')", answer="cast(p_partkey % 4 AS int)", subject="p_brand", part="p_partkey % 3", position="p_partkey")
    blank = {f"option_{i}": "CAST(NULL AS string)" for i in range(5, 10)}
    px = _raw(spark, sf_dir, question="p_name", option_0="''", option_1="'x'", option_2="'N/A'", option_3="CASE WHEN p_partkey % 2 = 0 THEN p_brand END", option_4="p_type", **blank,
              answer="'J'", category="p_brand", question_id="p_partkey", lang="'hi'")
    frames = {"xcopa": loaders.xcopa(xc, ["it", "zh"]), "mmmlu": loaders.mmmlu(mm), "ru": loaders.russian_mmlu(ru), "prox": loaders.mmlu_prox(px)}
    return _union([
        g.select(F.lit(n).alias("source"), F.md5("prompt").alias("prompt"), "answer", "idx", F.substring_index("idx", "_", 1).alias("lang")) for n, (g, _) in frames.items()
    ])


_OLD = [s for names in fixed.OLD_MACRO_OF_CATEGORY.values() for s in names] + ["sports", "Law "]


@query(f"""WITH {_map_sql('mo', fixed.OLD_MACRO_OF_CATEGORY)}, r AS (SELECT *, {_sql_list(_OLD)}[p_partkey % {len(_OLD)} + 1] AS c FROM part)
SELECT p_partkey, v AS macro_cat, (list_position({_sql_list(list(fixed.OLD_MACRO_OF_CATEGORY))}, v) - 1)::INT AS label, CASE WHEN p_partkey % 3 = 1 THEN 'B' ELSE 'A' END AS answer,
 md5('Answer the question clearly.' || chr(10) || p_partkey || chr(10) || 'Options:' || chr(10) || 'A. ' || p_name || chr(10) || 'B. ' || p_brand) AS prompt FROM r JOIN mo ON k = lower(trim(c))""")
def load_first_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older formatter, with its categories as class labels."""
    answer = "CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN ' ' || p_brand ELSE 'neither' END"
    raw = _raw(spark, sf_dir, p_partkey="p_partkey", question="cast(p_partkey AS string)", options="array(p_name, p_brand)", answer=answer, category=_pick(_OLD))
    good, _ = loaders.first_prep(raw)
    key = F.split("prompt", "\n")[1].cast("long")
    label = F.array_position(F.array(*map(F.lit, fixed.OLD_MACRO_OF_CATEGORY)), F.col("macro_cat")) - 1
    return good.select(key.alias("p_partkey"), "macro_cat", label.cast("int").alias("label"), "answer", F.md5("prompt").alias("prompt"))
