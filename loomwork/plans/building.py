"""Registered queries of pools, options, variants and quotas; registers with the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import fixed, text
from loomwork.operators import build, rows
from loomwork.plans.bindings import MCQ_SQL, load, mcq, option_counts
from loomwork.plans.catalog import query
from loomwork.workspace import Workspace

_T = r"regexp_replace({0}, '^[ \t-\r]+|[ \t-\r]+$', '', 'g')"


def _type(o: str) -> str:
    t = _T.format(o)
    return rf"""CASE WHEN {t} = '' THEN 'phrase' WHEN regexp_matches({t}, '^(1[0-9]{{3}}|20[0-9]{{2}}|2100)$') THEN 'year'
 WHEN regexp_matches({t}, '^[-+]?([0-9]+\.[0-9]+|[0-9]+/[0-9]+|[0-9]+,[0-9]+|[0-9]+)(\s*(%|[a-zA-Z][a-zA-Z0-9/^-]*))?$') THEN 'numeric'
 WHEN regexp_matches({t}, '^[A-Z]') AND len(string_split_regex({t}, '\s+')) <= 3 AND NOT regexp_matches({t}, '[.?!;]$|,') THEN 'short_entity' ELSE 'phrase' END"""


def _bucket(o: str) -> str:
    return f"CASE WHEN length({o}) <= 15 THEN 'S' WHEN length({o}) <= 60 THEN 'M' ELSE 'L' END"


_FORMS = [
    "'19' || (10 + p_size)", "p_size || '/4'", "p_size || ' mol/L'", "'-' || p_size || '.5 %'", "'1,' || (100 + p_size)", "upper(p_name)", "upper(p_name) || '.'", "p_name",
    "'Albert camus'", "'A B C D E'", "'Yes.'", "''", "'Paris, France'", "'2' || (p_size % 10) || '00'", "upper(p_brand) || repeat(' x', 9)", "'The ' || repeat('long ', 15)",
]
_FORM = "CASE p_partkey % {} {} END".format(len(_FORMS), " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMS)))


@query(f"WITH o AS (SELECT {_FORM} AS o FROM part) SELECT {_type('o')} AS type, {_bucket('o')} AS bucket, count(*) AS n FROM o GROUP BY 1, 2")
def option_type_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of many forms by type and length."""
    o = load(spark, sf_dir, "part").selectExpr(f"{_FORM} AS o")
    return o.groupBy(text.option_type(F.col("o")).alias("type"), text.length_bucket(F.col("o")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


#: Questions whose options are of several types and lengths.
_VARIED = f"""{MCQ_SQL}, vq AS (SELECT * REPLACE (list_transform(options, lambda o: CASE length(o) % 3 WHEN 0 THEN upper(o[1]) || o[2:] WHEN 1 THEN length(o) || ' kg' || o[1] ELSE o || ' of long names' END) AS options,
 CASE length(gold) % 3 WHEN 0 THEN upper(gold[1]) || gold[2:] WHEN 1 THEN length(gold) || ' kg' || gold[1] ELSE gold || ' of long names' END AS gold) FROM mcq),
pool AS (SELECT macro_cat, {_type('o')} AS type, o AS option, min(source) AS subject, {_bucket('o')} AS bucket FROM (SELECT macro_cat, source, trim(unnest(options)) AS o FROM vq) WHERE o <> '' GROUP BY macro_cat, type, o)"""


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    def form(o):
        n = F.length(o)
        big = F.concat(F.upper(F.substr(o, F.lit(1), F.lit(1))), F.substr(o, F.lit(2)))
        weight = F.concat(n.cast("string"), F.lit(" kg"), F.substr(o, F.lit(1), F.lit(1)))
        return F.when(n % 3 == 0, big).when(n % 3 == 1, weight).otherwise(F.concat(o, F.lit(" of long names")))

    return mcq(spark, sf_dir).withColumns({"options": F.transform("options", form), "gold": form(F.col("gold"))})


@query(f"WITH {_VARIED} SELECT macro_cat, type, count(*) AS n FROM pool GROUP BY GROUPING SETS ((macro_cat), (macro_cat, type))")
def pool_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct options to draw from, by category and by category and type."""
    return build.pool_sizes(build.option_pool(varied(spark, sf_dir)))


def _unit_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _distractor_sql(source: str, seed: int) -> str:
    """Tables that end in ``extra`` (qid, place, option) for ``source`` (qid, macro_cat, source, options, gold, need)."""
    tiers = ["macro_cat || '|' || subject || '|' || type", "macro_cat || '|' || type", "macro_cat"]
    names = ", ".join(x for t, k in enumerate(tiers) for x in (f"'{t}n|' || {k} || '|' || bucket", f"'{t}w|' || {k}"))
    both = ", ".join(f"{{tier: {t}, narrow: '{t}n|' || {k} || '|' || bucket, wide: '{t}w|' || {k}}}" for t, k in enumerate(tiers))
    primes = ", ".join(f"{p}::BIGINT" for p in build.step_primes())
    return f"""pl AS (SELECT list, lower(option) AS low, min(option) AS option FROM (SELECT option, unnest([{names}]) AS list FROM pool) GROUP BY ALL),
nl AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY md5('{seed}|' || low), low) AS pos, count(*) OVER (PARTITION BY list) AS size FROM pl), sz AS (SELECT DISTINCT list, size FROM nl),
q AS (SELECT qid, macro_cat, source AS subject, {_type('gold')} AS type, {_bucket('gold')} AS bucket, need, list_transform(options, lambda o: lower(trim(o))) AS own FROM {source}),
ask AS (SELECT qid, need, own, t.tier AS tier, CASE WHEN coalesce(n.size >= need + 4, false) THEN n.list ELSE w.list END AS list, CASE WHEN coalesce(n.size >= need + 4, false) THEN n.size ELSE w.size END AS size
 FROM (SELECT *, unnest([{both}]) AS t FROM q) LEFT JOIN sz n ON n.list = t.narrow JOIN sz w ON w.list = t.wide),
walk AS (SELECT *, floor({_unit_sql(f"'{seed}'", 'qid', 'tier', "'start'")} * size)::BIGINT AS start, [{primes}][1 + floor({_unit_sql(f"'{seed}'", 'qid', 'tier', "'step'")} * 64)::INT] % size AS by_, unnest(range(0, least(need + len(own), size))) AS step FROM ask),
first AS (SELECT qid, need, low, min(struct_pack(tier := tier, step := step, option := option)) AS x FROM (SELECT *, (start + step * by_) % size + 1 AS pos FROM walk) JOIN nl USING (list, pos) WHERE NOT list_contains(own, low) GROUP BY ALL),
extra AS (SELECT qid, x.option AS option, row_number() OVER (PARTITION BY qid ORDER BY x) AS place FROM first QUALIFY place <= need)"""


def _shuffle_sql(options: str, seed: int) -> str:
    return f"list_transform(list_sort(list_transform({options}, lambda o: struct_pack(h := md5('{seed}|' || qid || '|' || o), o := o))), lambda x: x.o)"


_EXPANDED = f"""more AS (SELECT qid, list(option ORDER BY place) AS m FROM extra GROUP BY qid), grown AS (SELECT qid, gold, {_shuffle_sql('list_concat(options, m)', 6)} AS options FROM asked JOIN more USING (qid))"""


@query(f"""WITH {_VARIED}, asked AS (SELECT *, qid % 4 + 1 AS need FROM vq), {_distractor_sql('asked', 5)}, {_EXPANDED}
SELECT qid, array_to_string(options, '|') AS options, (list_position(options, gold) - 1)::INT AS gold_idx, len(options)::INT AS k, '_aug_exp' || len(options) AS suffix FROM grown""")
def expand_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with one to four options more, of the gold's type and length where there are enough."""
    q = Workspace(spark, "varied").save(varied(spark, sf_dir), "questions")  # read by the pool, the asking and the result
    asked = q.withColumn("need", (F.col("qid") % 4 + 1).cast("int"))
    grown = build.expand(asked, build.distractors(asked, build.option_pool(q), 5), 6)
    return grown.withColumn("options", F.array_join("options", "|"))


@query(f"""WITH {_VARIED}, turns AS (SELECT *, row_number() OVER (PARTITION BY macro_cat ORDER BY md5('3|' || qid), qid) AS turn FROM vq WHERE n_options <= 10), base AS (SELECT * FROM turns ORDER BY turn, macro_cat LIMIT 60),
asked AS (SELECT * FROM (SELECT *, 11 + floor({_unit_sql("'8'", 'qid')} * 10)::INT - n_options AS need FROM base)), {_distractor_sql('asked', 5)}, {_EXPANDED}
SELECT qid, len(options)::INT AS k, md5(array_to_string(options, '|')) AS options FROM grown""")
def dev_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 questions of at most ten options, in turn by category, with 11 to 20 options."""
    q = Workspace(spark, "varied").save(varied(spark, sf_dir), "questions")  # read by the pool, the asking and the result
    base = rows.round_robin(q.where("n_options <= 10"), "macro_cat", [rows.hash_order(3, "qid"), F.col("qid")], 60)
    k = 11 + build.offset(F.lit(10), F.lit(8), F.col("qid"))
    asked = base.withColumn("need", (k - F.col("n_options")).cast("int"))
    grown = build.expand(asked, build.distractors(asked, build.option_pool(q), 5), 6)
    return grown.select("qid", "k", F.md5(F.array_join("options", "|")).alias("options"))


@query(f"WITH {MCQ_SQL}, s AS (SELECT qid, gold, {_shuffle_sql('options', 11)} AS options FROM mcq) SELECT qid, array_to_string(options, '|') AS options, chr((64 + list_position(options, gold))::INT) AS gold_letter FROM s")
def shuffle_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options in a new order, with the gold's new letter."""
    q = mcq(spark, sf_dir).select("qid", "gold", build.shuffled(F.col("options"), F.col("qid"), 11).alias("o"))
    return q.select("qid", F.array_join("o", "|").alias("options"), F.char(F.lit(64) + F.array_position("o", F.col("gold"))).alias("gold_letter"))


_KS = "[" + ", ".join(map(str, fixed.EXPAND_WEIGHTS)) + "]"
_WS = "[" + ", ".join(f"{w}::DOUBLE" for w in fixed.EXPAND_WEIGHTS.values()) + "]"


@query(f"""WITH {MCQ_SQL}, t AS (SELECT qid, n_options, i, {_unit_sql("'4'", 'qid', 'i')} AS u FROM mcq, range(6) r(i)), w AS (SELECT unnest({_KS}) AS k, unnest({_WS}) AS w),
c AS (SELECT t.qid, t.i, t.u, w.k, sum(w) OVER (PARTITION BY t.qid, t.i ORDER BY k) AS upto, sum(w) OVER (PARTITION BY t.qid, t.i) AS total FROM t JOIN w ON k > n_options),
d AS (SELECT qid, i, min(k) AS k FROM c WHERE u * total < upto GROUP BY qid, i), f AS (SELECT qid, k, min(i) AS i FROM d GROUP BY qid, k QUALIFY row_number() OVER (PARTITION BY qid ORDER BY min(i)) <= 2)
SELECT qid, n_options::INT AS k, false AS is_augmented FROM mcq UNION ALL SELECT qid, k::INT, true FROM f""")
def emit_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question, then up to two variants with more options, whose counts are drawn by weight."""
    q = option_counts(spark, sf_dir)
    ks = build.weighted_counts(F.col("n_options"), F.col("qid"), 4)
    rows_ = F.concat(F.array(F.struct(F.col("n_options").alias("k"), F.lit(False).alias("is_augmented"))), F.transform(ks, lambda k: F.struct(k.alias("k"), F.lit(True).alias("is_augmented"))))
    return q.select("qid", F.explode(rows_).alias("r")).select("qid", "r.*")


_QUOTAS = {"1-URGENT": 0.35, "2-HIGH": 0.30, "3-MEDIUM": 0.20, "4-NOT SPECIFIED": 0.10, "5-LOW": 0.05}
_TOTAL, _AUG = 500, 0.2


@query(f"""WITH {MCQ_SQL}, r AS (SELECT qid, macro_cat, false AS is_augmented FROM mcq WHERE macro_cat <> '1-URGENT' OR n_options > 6 UNION ALL SELECT qid, macro_cat, true FROM mcq WHERE n_options <= 3),
p(macro_cat, quota) AS (VALUES {', '.join(f"('{m}', {q}::DOUBLE)" for m, q in _QUOTAS.items())}),
g AS (SELECT macro_cat, round({_TOTAL} * quota)::BIGINT + CASE WHEN macro_cat = '1-URGENT' THEN {_TOTAL} - (SELECT sum(round({_TOTAL} * quota))::BIGINT FROM p) ELSE 0 END AS goal FROM p),
c AS (SELECT macro_cat, goal, count_if(NOT is_augmented) AS o, count_if(is_augmented) AS a FROM g LEFT JOIN r USING (macro_cat) GROUP BY ALL),
t AS (SELECT *, least(round({_AUG} * goal)::BIGINT, a) AS ta0, least(goal - least(round({_AUG} * goal)::BIGINT, a), o) AS tor FROM c), t2 AS (SELECT *, ta0 + least(goal - tor - ta0, a - ta0) AS ta FROM t),
n AS (SELECT *, md5('13|' || qid || '|' || is_augmented::VARCHAR) AS h, row_number() OVER (PARTITION BY macro_cat, is_augmented ORDER BY md5('13|' || qid || '|' || is_augmented::VARCHAR), qid) AS pos FROM r),
f AS (SELECT n.*, pos <= CASE WHEN is_augmented THEN ta ELSE tor END AS taken FROM n JOIN t2 USING (macro_cat)),
l AS (SELECT *, row_number() OVER (ORDER BY h, qid) AS place FROM f WHERE NOT taken)
SELECT qid, macro_cat, is_augmented, false AS filled FROM f WHERE taken UNION ALL SELECT qid, macro_cat, is_augmented, true FROM l WHERE place <= (SELECT sum(goal - tor - ta) FROM t2)""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 questions and variants by quotas of the categories; one category has too few."""
    q = mcq(spark, sf_dir).select("qid", "macro_cat", "n_options")
    originals = q.where("macro_cat <> '1-URGENT' OR n_options > 6").select("qid", "macro_cat", F.lit(False).alias("is_augmented"))
    variants = q.where("n_options <= 3").select("qid", "macro_cat", F.lit(True).alias("is_augmented"))
    return build.quota_sample(originals.unionByName(variants), _TOTAL, _QUOTAS, _AUG, 13)


_TRIVIA = f"""x AS (SELECT p_partkey AS qid, {_FORM} AS gold, [p_brand, lower(p_name)] AS aliases FROM part), qs AS (SELECT qid, {_type('gold')} AS type, regexp_replace(lower(trim(gold)), '\\s+', ' ', 'g') AS g, gold,
 list_append(aliases_low, regexp_replace(lower(trim(gold)), '\\s+', ' ', 'g')) AS aliases FROM (SELECT *, list_transform(aliases, lambda a: lower(trim(a))) AS aliases_low FROM x WHERE lower(trim(gold)) NOT IN ('', 'unknown', 'n/a', 'none', 'null'))),
pl AS (SELECT type, g AS low, min(gold) AS option FROM qs GROUP BY ALL), ls AS (SELECT type AS list, * FROM pl UNION ALL SELECT '', * FROM pl),
nl AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY md5('21|' || low), low) AS pos, count(*) OVER (PARTITION BY list) AS size FROM ls), sz AS (SELECT DISTINCT list, size FROM nl),
ak AS (SELECT qid, type, g, aliases, tier, CASE tier WHEN 0 THEN type ELSE '' END AS list FROM qs, range(2) r(tier)), st AS (SELECT ak.*, size, floor({_unit_sql("'21'", 'qid', 'tier')} * size)::BIGINT AS start FROM ak JOIN sz USING (list)),
md AS (SELECT qid, low, min(struct_pack(tier := tier, step := (pos - 1 - start + size) % size, option := option)) AS x FROM (SELECT st.*, nl.pos, nl.low, nl.option, nl.type AS kind FROM st JOIN nl USING (list))
 WHERE NOT list_contains(aliases, low) AND NOT contains(g, low) AND NOT contains(low, g) AND (tier = 0 OR kind <> type) GROUP BY ALL)"""


@query(f"WITH {_TRIVIA} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY x)::INT AS place, x.option AS option FROM md QUALIFY place <= 3")
def trivia_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three wrong answers for every free answer that is no garbage."""
    q = load(spark, sf_dir, "part").selectExpr("p_partkey AS qid", f"{_FORM} AS gold", "array(p_brand, lower(p_name)) AS aliases")
    garbage = F.lower(F.trim("gold")).isin("", *fixed.GARBAGE_GOLDS) | ((F.length(F.trim("gold")) == 1) & ~F.trim("gold").rlike(r"[\p{L}\p{N}]"))
    return build.trivia_options(q.where(~garbage), 21)


def _rebalance_sql(seed: int = 42, low: int = 2, high: int = 20, peak: float = 4.0, shape: int = 4, edge: float = 0.35) -> str:
    """Tables that end in ``spans`` (lang, has, low, high, target) for ``rows_`` (idx, lang, choices, has): a step a target, the largest first."""
    steps, spans = [f"u{high + 1} AS (SELECT lang, has, count(*) AS n, 0::BIGINT AS used, sum(count(*)) OVER (PARTITION BY lang)::BIGINT AS total FROM rows_ GROUP BY lang, has)"], []
    for k, share in sorted(build.choice_shares(low, high, peak, shape, edge).items(), reverse=True):
        steps.append(f"""e{k} AS (SELECT *, sum(n - used) OVER (PARTITION BY lang ORDER BY has)::BIGINT AS upto, sum(n - used) OVER (PARTITION BY lang)::BIGINT AS eligible FROM u{k + 1} WHERE has >= {k} AND n > used),
w{k} AS (SELECT *, least(floor({share!r}::DOUBLE * total)::BIGINT, eligible) AS want, floor({_unit_sql(f"'{seed}'", "coalesce(lang, '')", f"'{k}'")} * eligible)::BIGINT AS start FROM e{k}),
p{k} AS (SELECT lang, has, (upto * want - start + eligible - 1) // eligible - ((upto - (n - used)) * want - start + eligible - 1) // eligible AS picks FROM w{k} WHERE want > 0),
u{k} AS (SELECT u.lang, u.has, n, used + coalesce(picks, 0) AS used, total FROM u{k + 1} u LEFT JOIN p{k} p ON u.has = p.has AND u.lang IS NOT DISTINCT FROM p.lang)""")
        spans.append(f"SELECT u.lang, u.has, used AS low, used + picks AS high, {k} AS target FROM u{k + 1} u JOIN p{k} p ON u.has = p.has AND u.lang IS NOT DISTINCT FROM p.lang WHERE picks > 0")
    return ", ".join([*steps, f"spans AS ({' UNION ALL '.join(spans)})"])


@query(f"""WITH {MCQ_SQL}, rows_ AS (SELECT qid AS idx, macro_cat AS lang, list_filter(options, lambda o: o <> gold) AS choices, least(len(options), 20) AS has FROM mcq), {_rebalance_sql()},
placed AS (SELECT *, row_number() OVER (PARTITION BY lang, has ORDER BY md5('42|' || idx), idx) AS pos FROM rows_)
SELECT idx, p.lang, target::INT AS target, array_to_string(choices[1 : target - 1], '|') AS kept, (len(choices) - target + 1)::INT AS ignored FROM placed p JOIN spans s ON s.lang = p.lang AND s.has = p.has AND pos > low AND pos <= high""")
def rebalance_choice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with as many choices as a peaked mixture wants, by category."""
    q = mcq(spark, sf_dir).select(F.col("qid").alias("idx"), F.col("macro_cat").alias("lang"), F.array_remove("options", F.col("gold")).alias("choices"))
    b = build.rebalance(q, "lang", 42)
    return b.select("idx", "lang", "target", F.array_join("kept", "|").alias("kept"), F.size("ignored").alias("ignored"))
