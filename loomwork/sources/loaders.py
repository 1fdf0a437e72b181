"""Record loaders: raw records of public question sets as examples, with those they reject.

Every loader takes a DataFrame of raw records and returns (examples, rejects).
Examples have question, options, gold_idx, source, macro_cat, cot, subject and uid;
maths records have prompt, answer, completion and columns of their own; multilingual
ones prompt, answer, idx, subject and lang.  Rejects keep the raw columns.  A null
anywhere rejects a record or counts as empty, as its loader says; nothing is dropped
silently.  ``first_valid`` caps a source after its rejects, in a given order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import answers, fixed, text
from loomwork.operators import build
from loomwork.workspace import Workspace

Loaded = tuple[DataFrame, DataFrame]
MACROS = list(fixed.MACRO_QUOTAS)


def clean(c: Column | str) -> Column:
    """Text without outer white space; null is empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def macro_of(value: Column, table: dict[str, list[str]], default: str = "commonsense") -> Column:
    """The category of a subject by a fixed table, blind to case and outer space."""
    pairs = [F.lit(x) for macro, names in table.items() for name in names for x in (name, macro)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(clean(value))), F.lit(default))


def _split(df: DataFrame, valid: Column, columns: dict[str, Column]) -> Loaded:
    good = F.coalesce(valid, F.lit(False))
    return df.where(good).select(*(c.alias(n) for n, c in columns.items())), df.where(~good)


def _examples(
    df: DataFrame, question: Column, options: Column, gold: Column, valid: Column, source: str, macro: Column | str, subject: Column | str, cot: Column | None = None
) -> Loaded:
    """Options must be 1 to 26 and hold the gold index; the macro category must be one of the five."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    fits = (F.size(options) >= 1) & (F.size(options) <= 26) & (gold >= 0) & (gold < F.size(options)) & lit(macro).isin(MACROS)
    cot = F.lit(None).cast("string") if cot is None else F.nullif(cot, F.lit(""))
    columns = {
        "question": question, "options": options, "gold_idx": gold.cast("int"), "source": F.lit(source), "macro_cat": lit(macro),
        "cot": cot, "subject": lit(subject), "uid": text.stable_uid(question),
    }
    return _split(df, valid & fits, columns)


def _listed(options: str) -> Column:
    return F.transform(F.filter(options, lambda x: x.isNotNull()), lambda x: clean(x))


def mmlu(df: DataFrame, source: str = "mmlu") -> Loaded:
    """question, choices, answer (0-based), subject; null choices go, two or more must be left."""
    q, options = clean("question"), _listed("choices")
    return _examples(df, q, options, F.col("answer"), (q != "") & (F.size(options) >= 2), source, macro_of(F.col("subject"), fixed.MACRO_OF_SUBJECT), F.coalesce("subject", F.lit("")))


def mmlu_pro(df: DataFrame) -> Loaded:
    """question, options, answer_index, else the letter answer; category."""
    q, options, letter = clean("question"), _listed("options"), F.upper(clean("answer"))
    gold = F.coalesce("answer_index", F.when(F.length(letter) == 1, F.ascii(letter) - 65))
    macro = macro_of(F.col("category"), fixed.MACRO_OF_CATEGORY)
    return _examples(df, q, options, gold, (q != "") & (F.size(options) >= 2), "mmlu_pro", macro, F.coalesce("category", F.lit("")))


def inline_options(question: Column) -> Column:
    """struct(stem, options) of a question whose lines ``A. x`` to ``J) x`` are options; a line after
    an option that has no label goes on with it, what is before the first is the stem."""
    mark = r"(?U)^\s*([A-J])[.)]\s+(.*)$"
    line = lambda x: F.regexp_replace(x, r"(?U)\s+$", "")
    start = F.struct(F.array().cast("array<string>").alias("stem"), F.array().cast("array<string>").alias("options"))

    def step(s: Column, raw: Column) -> Column:
        x = line(raw)
        own = clean(F.regexp_extract(x, mark, 2))
        more = F.concat(F.slice(s["options"], F.lit(1), F.size(s["options"]) - 1), F.array(clean(F.concat(F.element_at(s["options"], -1), F.lit(" "), clean(x)))))
        return (
            F.when(x.rlike(mark), F.struct(s["stem"].alias("stem"), F.concat(s["options"], F.array(own)).alias("options")))
            .when(F.size(s["options"]) == 0, F.struct(F.concat(s["stem"], F.array(x)).alias("stem"), s["options"].alias("options")))
            .when(clean(x) == "", s)
            .otherwise(F.struct(s["stem"].alias("stem"), more.alias("options")))
        )

    parsed = F.aggregate(F.split(F.coalesce(question, F.lit("")), "\r\n|\r|\n"), start, step)
    return F.transform(F.array(parsed), lambda p: F.struct(clean(F.array_join(p["stem"], "\n")).alias("stem"), p["options"].alias("options")))[0]


def joined_cot(steps: Column) -> Column:
    """A list of steps as one text, nulls left out; null if there is none."""
    return F.nullif(clean(F.array_join(steps, "\n")), F.lit(""))


def json_cot(raw: Column) -> Column:
    """An explanation that may be a JSON list of lines, else as it stands."""
    return F.coalesce(F.array_join(F.try_variant_get(F.try_parse_json(raw), "$", "array<string>"), "\n"), raw)


def mmlu_pro_cot(df: DataFrame) -> Loaded:
    """question with its options inside, answer (letter), category, chain_of_thoughts (lines)."""
    df = df.withColumn("_parsed", inline_options(F.col("question")))
    stem, options, letter = F.col("_parsed.stem"), F.col("_parsed.options"), F.upper(clean("answer"))
    gold = F.when(F.length(letter) == 1, F.ascii(letter) - 65)
    macro = macro_of(F.col("category"), fixed.MACRO_OF_CATEGORY)
    good, bad = _examples(df, stem, options, gold, stem != "", "mmlu_pro_cot", macro, F.coalesce("category", F.lit("")), F.coalesce(joined_cot(F.col("chain_of_thoughts")), F.lit("")))
    return good, bad.drop("_parsed")


def mmlu_world(df: DataFrame) -> Loaded:
    """The mmlu records of the world-knowledge subjects; the others are rejects."""
    ours = F.coalesce(F.col("subject").isin(fixed.WORLD_SUBJECTS), F.lit(False))
    good, bad = mmlu(df.where(ours), "mmlu_world")
    return good, bad.unionByName(df.where(~ours))


def boolq(df: DataFrame) -> Loaded:
    """question and a yes/no answer, without the passage."""
    q = clean("question")
    asked = F.when(q.endswith("?"), q).otherwise(F.concat(q, F.lit("?")))
    gold = F.when(F.col("answer"), 0).otherwise(1)
    return _examples(df, asked, F.array(F.lit("Yes"), F.lit("No")), gold, (q != "") & F.col("answer").isNotNull(), "boolq", "commonsense", "boolq")


def _keyed(df: DataFrame, source: str, macro: str, subject: str, upper: bool, all_filled: bool) -> Loaded:
    """question, choices(label, text) of equal lengths, answerKey among the labels; options in the labels' text order."""
    q, key, labels, texts = clean("question"), clean("answerKey"), F.col("choices.label"), F.col("choices.text")
    key = F.upper(key) if upper else key
    pairs = F.sort_array(F.transform(F.arrays_zip(labels.alias("l"), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: i).alias("i"), texts.alias("t")), lambda p: p))
    options = F.transform(pairs, lambda p: clean(p["t"]))
    gold = F.array_position(F.transform(pairs, lambda p: p["l"]), key) - 1
    valid = (q != "") & (F.size(labels) > 0) & (F.size(labels) == F.size(texts)) & (key != "") & F.array_contains(labels, key)
    if all_filled:
        valid = valid & F.forall(options, lambda o: o != "")
    return _examples(df, q, options, gold, valid, source, macro, subject)


def commonsenseqa(df: DataFrame) -> Loaded:
    return _keyed(df, "commonsenseqa", "commonsense", "commonsense", True, False)


def arc_challenge(df: DataFrame) -> Loaded:
    return _keyed(df, "arc_challenge", "stem", "arc_science", False, True)


def openbookqa(df: DataFrame) -> Loaded:
    return _keyed(df, "openbookqa", "stem", "openbookqa", False, True)


def ecqa(df: DataFrame) -> Loaded:
    """q_text, q_op1 to q_op5 all filled, q_ans equal to one of them but for case (the first), taskB."""
    q, options, gold = clean("q_text"), F.array(*(clean(f"q_op{i}") for i in range(1, 6))), F.lower(clean("q_ans"))
    at = F.array_position(F.transform(options, lambda o: F.lower(o)), gold) - 1
    valid = (q != "") & F.forall(options, lambda o: o != "") & (gold != "")
    return _examples(df, q, options, at, valid, "ecqa", "commonsense", "commonsense", clean("taskB"))


def socialiqa(df: DataFrame) -> Loaded:
    """context (may be empty) and question, answerA to answerC, label 1 to 3."""
    q, context, label = clean("question"), clean("context"), clean("label")
    options = F.array(*(clean(f"answer{x}") for x in "ABC"))
    stem = F.when(context != "", F.concat(context, F.lit("\n\n"), q)).otherwise(q)
    valid = (q != "") & F.forall(options, lambda o: o != "") & label.isin("1", "2", "3")
    return _examples(df, stem, options, F.expr("try_cast(label AS int)") - 1, valid, "socialiqa", "commonsense", "social_commonsense")


def _thought(solution: Column, answer: Column, wrap: bool = True) -> Column:
    before, after = fixed.FINAL_LINE.split("%s")
    body = F.concat(F.lit("<think>\n"), solution, F.lit("\n</think>")) if wrap else solution
    return F.concat(body, F.lit("\n\n" + before), answer, F.lit(after))


def competition_math(df: DataFrame) -> Loaded:
    """problem, solution, level, type; the answer is the solution's last box, and must not be empty."""
    solution = clean("solution")
    answer = answers.own_box(solution)
    out = {"prompt": clean("problem"), "answer": answer, "completion": _thought(solution, answer), "level": F.col("level"), "type": F.col("type")}
    return _split(df, answer != "", out)


def math500(df: DataFrame) -> Loaded:
    """problem, solution, answer, subject, level: none is rejected; null reads None."""
    own = lambda c: clean(F.coalesce(F.col(c).cast("string"), F.lit("None")))
    out = {"prompt": own("problem"), "answer": own("answer"), "completion": _thought(own("solution"), own("answer")), "level": own("level"), "type": own("subject")}
    return _split(df, F.lit(True), out)


def open_math_instruct(df: DataFrame) -> Loaded:
    """problem, generated_solution, expected_answer, problem_source: none is rejected."""
    own = lambda c: clean(F.coalesce(F.col(c).cast("string"), F.lit("None")))
    answer = own("expected_answer")
    out = {"prompt": own("problem"), "answer": answer, "completion": _thought(own("generated_solution"), answer), "problem_source": F.col("problem_source")}
    return _split(df, F.lit(True), out)


def open_r1(df: DataFrame) -> Loaded:
    """The shortest generation that is complete and right, the first of equal ones; rejected without any."""
    zipped = F.arrays_zip(F.col("generations").alias("g"), F.col("is_reasoning_complete").alias("c"), F.col("correctness_math_verify").alias("v"))
    short = F.least(F.size("generations"), F.size("is_reasoning_complete"), F.size("correctness_math_verify"))
    good = F.filter(F.transform(F.slice(zipped, F.lit(1), short), lambda x, i: F.struct(F.length(x["g"]).alias("n"), i.alias("i"), x["g"].alias("g"), (x["c"] & x["v"]).alias("ok"))), lambda x: x["ok"])
    best = clean(F.array_min(F.transform(good, lambda x: F.struct(x["n"].alias("n"), x["i"].alias("i"), x["g"].alias("g"))))["g"])
    out = {"prompt": F.col("problem"), "answer": F.col("answer"), "completion": _thought(best, clean("answer"), False)}
    out |= {c: F.col(c) for c in ("problem_type", "question_type", "source", "uuid")}
    return _split(df, F.size(good) > 0, out)


def is_bad_answer(answer: Column) -> Column:
    """Empty, or a word for none."""
    return F.lower(clean(answer)).isin("", *fixed.BAD_ANSWERS)


def is_yes(flag: Column) -> Column:
    return F.lower(clean(flag.cast("string"))).isin(*fixed.YES)


def has_image(prompt: Column) -> Column:
    """A mark of an image: ``![](``, an ``<img`` tag, ``<image 1>`` or ``<img_1>``."""
    return prompt.contains("![](") | prompt.rlike(r"(?i)<img\b|<image[_\s-]*\d*>|<img[_\s-]*\d+>")


def safe_rows(df: DataFrame, prompt: Column, answer: Column, source: str, valid: Column, **metadata: Column) -> Loaded:
    """Prompts with an answer and no image; empty metadata are null."""
    p, a = clean(prompt), clean(answer)
    filled = {n: F.nullif(c.cast("string"), F.lit("")) for n, c in metadata.items()}
    return _split(df, valid & (p != "") & ~is_bad_answer(answer) & ~has_image(p), {"prompt": p, "answer": a, "source": F.lit(source), **filled})


def numina_math(df: DataFrame) -> Loaded:
    """problem, answer and flags: null passes, else yes; proofs are rejected."""
    passes = lambda c: F.col(c).isNull() | is_yes(F.col(c))
    valid = passes("problem_is_valid") & passes("solution_is_valid") & (F.lower(clean("question_type")) != "proof")
    meta = {"original_source": F.col("source"), "problem_type": F.col("problem_type"), "question_type": F.col("question_type"), "synthetic": F.col("synthetic")}
    return safe_rows(df, F.col("problem"), F.col("answer"), "numinamath_1_5", valid, **meta)


def nemotron_math(df: DataFrame) -> Loaded:
    """problem, expected_answer; rows with tools or an answer changed to the majority's are rejected."""
    valid = ~F.coalesce(F.col("changed_answer_to_majority"), F.lit(False)) & (F.coalesce(F.size("tools"), F.lit(0)) <= 0)
    return safe_rows(df, F.col("problem"), F.col("expected_answer"), "nemotron_math_v2", valid, original_source=F.col("data_source"), uuid=F.col("uuid"))


def existing_split(df: DataFrame, source: str) -> Loaded:
    """prompt, answer and metadata under either of two names, the first that is not empty."""
    either = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")))
    meta = {"original_source": either("source", "problem_source"), "problem_type": either("problem_type", "type"), "level": F.col("level")}
    return safe_rows(df, F.col("prompt"), F.col("answer"), source, F.lit(True), **meta)


def _lettered(question: Column, options: Column, gap: str = "\n\n") -> Column:
    return F.concat(question, F.lit(gap), text.labelled(options, ") "))


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.lower(F.substr(x, F.lit(2))))


def xcopa(df: DataFrame, languages: list[str]) -> Loaded:
    """premise, question (cause or effect), choice1, choice2, label, idx, lang; of the configured languages."""
    asked = F.concat(F.col("premise"), F.lit(" "), _capital(F.col("question")), F.lit(" ?"))
    out = {
        "prompt": _lettered(asked, F.array("choice1", "choice2")), "answer": F.when(F.col("label") == 0, "A").otherwise("B"),
        "idx": F.concat_ws("_", "lang", F.col("idx").cast("string")), "lang": F.col("lang"),
    }
    return _split(df, F.col("lang").isin(languages), out)


def mmmlu(df: DataFrame) -> Loaded:
    """Question, A to D, Answer, Subject, Language, n (position): repeated prompts keep the first by idx."""
    out = {
        "prompt": _lettered(F.col("Question"), F.array("A", "B", "C", "D")), "answer": F.col("Answer"),
        "idx": F.concat_ws("_", "Language", "Subject", F.col("n").cast("string")), "subject": F.col("Subject"), "lang": F.col("Language"),
    }
    good, bad = _split(df, F.lit(True), out)
    row = F.struct("idx", "answer", "subject", "lang")
    return good.groupBy("prompt").agg(F.min(row).alias("r")).select("prompt", "r.*"), bad


def russian_mmlu(df: DataFrame) -> Loaded:
    """question_ru, choices_ru (four, else an error), answer (0-based), subject, part (order of its split), position."""
    position = F.expr("row_number() OVER (PARTITION BY subject ORDER BY part, position) - 1").cast("string")
    four = F.assert_true(F.size("choices_ru") == 4, "a question has other than four choices")
    df = df.withColumn("idx", F.concat_ws("_", F.lit("ru"), "subject", position))
    out = {
        "prompt": F.when(four.isNull(), _lettered(F.col("question_ru"), F.col("choices_ru"))),
        "answer": F.char(F.lit(65) + F.col("answer")), "idx": F.col("idx"), "subject": F.col("subject"),
    }
    good, bad = _split(df, F.lit(True), out)
    return good, bad.drop("idx")


def mmlu_prox(df: DataFrame) -> Loaded:
    """question, option_0 to option_9 (null, empty and N/A go; letters close up), answer as given, category, question_id, lang."""
    options = F.filter(F.array(*(F.col(f"option_{i}") for i in range(10))), lambda o: ~F.coalesce(o, F.lit("")).isin("", "N/A"))
    lines = F.array_join(F.transform(options, lambda x, i: F.concat(F.lit("\n"), F.char(F.lit(65) + i), F.lit(") "), x)), "")
    out = {
        "prompt": F.concat(F.col("question"), F.lit("\n"), lines), "answer": F.col("answer"),
        "idx": F.concat_ws("_", "lang", "category", F.col("question_id").cast("string")), "subject": F.col("category"), "lang": F.col("lang"),
    }
    return _split(df, F.lit(True), out)


def first_prep(df: DataFrame) -> Loaded:
    """The older formatter of question, options, answer text and category: a gold that is no option is
    the first; an unknown category is world_knowledge, which is none of the five, so it is rejected."""
    folded = lambda c: F.regexp_replace(F.lower(clean(c)), r"(?U)\s+", " ")
    at = F.array_position(F.transform("options", folded), folded(F.col("answer")))
    macro = macro_of(F.col("category"), fixed.OLD_MACRO_OF_CATEGORY, "world_knowledge")
    lines = F.concat(F.lit("Answer the question clearly.\n"), F.col("question"), F.lit("\nOptions:\n"), text.labelled(F.col("options")))
    out = {"prompt": lines, "answer": F.char(F.lit(64) + F.greatest(at, F.lit(1))), "macro_cat": macro}
    return _split(df, macro != "world_knowledge", out)


def triviaqa(df: DataFrame, seed: int = 42, need: int = 3) -> Loaded:
    """question_id (unique), question, answer.value, answer.aliases: a free answer becomes four options, three of them other questions' answers.

    Empty questions and golds that are garbage are rejected, and so are questions for which
    no three wrong answers can be found.  Wrong answers come from the answers that are kept."""
    q, gold = clean("question"), clean(F.col("answer.value"))
    garbage = F.lower(gold).isin("", *fixed.GARBAGE_GOLDS) | ((F.length(gold) == 1) & ~gold.rlike(r"[\p{L}\p{N}]"))
    valid = (q != "") & ~garbage
    asked = df.where(valid).select(F.col("question_id").alias("qid"), gold.alias("gold"), F.coalesce(F.col("answer.aliases"), F.array().cast("array<string>")).alias("aliases"))
    work = Workspace(df.sparkSession, "triviaqa")
    extra = build.trivia_options(work.save(asked, "asked"), seed, need)
    extra = extra.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", F.trim("option").alias("option")))).alias("_m")).where(F.size("_m") == need)
    extra = work.save(extra.withColumnRenamed("qid", "question_id"), "extra")
    found = df.join(extra, "question_id", "left")
    options = build.shuffled(F.concat(F.array(gold), F.transform("_m", lambda x: x["option"])), F.col("question_id"), seed)
    at = F.array_position(options, gold) - 1
    good, bad = _examples(found, q, options, at, valid & F.col("_m").isNotNull(), "triviaqa", "history_geo", "triviaqa")
    return good, bad.drop("_m")


def first_valid(examples: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """At most ``limit`` examples, in order: rejects don't count."""
    return examples if limit is None else examples.orderBy(*order).limit(limit)


#: The sources in the order of their priority in a merge.
REGISTRY = {
    "mmlu_pro_cot": mmlu_pro_cot, "ecqa": ecqa, "mmlu": mmlu, "mmlu_world": mmlu_world, "boolq": boolq, "socialiqa": socialiqa,
    "commonsenseqa": commonsenseqa, "mmlu_pro": mmlu_pro, "arc_challenge": arc_challenge, "openbookqa": openbookqa, "triviaqa": triviaqa,
}


@dataclass
class Isolated:
    """What of the sources could be read.  examples: of all sources, None if there are
    none; quarantine: source, reason, row (as JSON) of what failed alone; failed: why
    whole sources are left out."""

    examples: DataFrame | None
    quarantine: DataFrame | None
    failed: dict[str, str]


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e).splitlines()[0][:500]}"


def isolated(raw: DataFrame, load: Callable[[DataFrame], DataFrame], work: Workspace, name: str, most: int = 64, ways: int = 16) -> tuple[list[DataFrame], list[DataFrame]]:
    """(parts of the examples, quarantined rows) of one source whose loader may raise on some rows.

    The whole is written at once.  If that fails, the raw rows are written with numbers
    (a file that breaks off keeps what was read of it), dealt to ``ways`` parts by hash,
    and each part is loaded by itself; a part that fails is dealt anew, down to single
    rows.  ``load`` must judge each row by itself.  After ``most`` failed parts the
    source is given up as a whole: it is the loader that fails, not some rows."""
    spark = raw.sparkSession
    try:
        return [work.save(load(raw), f"{name}-whole")], []
    except Exception as e:  # noqa: BLE001  (whatever a source's reader or loader raises)
        if isinstance(e, AnalysisException):  # it cannot even be planned
            raise
    setting = "spark.sql.files.ignoreCorruptFiles"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        rows = work.save(raw.select("*", F.monotonically_increasing_id().alias("_row")), f"{name}-raw")
    finally:
        spark.conf.set(setting, before)
    whole, bad, failures = [], [], 0
    todo = [(rows, 0)]
    while todo:
        part, depth = todo.pop()
        try:
            whole.append(work.save(load(part.drop("_row")), f"{name}-{len(whole)}"))
            continue
        except Exception as e:  # noqa: BLE001
            failures += 1
            if failures > most:
                raise
            if part.limit(2).count() == 1:
                bad.append(part.select(F.lit(name).alias("source"), F.lit(_reason(e)).alias("reason"), F.to_json(F.struct(*raw.columns)).alias("row")))
                continue
        place = F.pmod(F.xxhash64("_row", F.lit(depth)), F.lit(ways))
        dealt = work.save(part.withColumn("_part", place), f"{name}-dealt{failures}")
        there = [r["_part"] for r in dealt.select("_part").distinct().collect()]  # at most ``ways``
        todo += [(dealt.where(F.col("_part") == p).drop("_part"), depth + 1) for p in sorted(there)]
    return whole, bad


def load_isolated(raw: dict[str, DataFrame], registry: dict[str, Callable[[DataFrame], Loaded]] | None = None, most: int = 64) -> Isolated:
    """Examples of every registered source in ``raw`` with its place as ``source_ord``; sources and rows that fail stay out of the others' way.

    ``most``: parts of a source that may fail before it is given up (see ``isolated``)."""
    examples, bad, failed = [], [], {}
    for place, (name, loader) in enumerate((registry or REGISTRY).items()):
        if name not in raw:
            continue
        load = lambda df, loader=loader, place=place: loader(df)[0].withColumn("source_ord", F.lit(place))
        try:
            whole, alone = isolated(raw[name], load, Workspace(raw[name].sparkSession, "source"), name, most)
        except Exception as e:  # noqa: BLE001
            failed[name] = _reason(e)
            continue
        examples, bad = examples + whole, bad + alone
    union = lambda parts: reduce(DataFrame.unionByName, parts) if parts else None
    return Isolated(union(examples), union(bad), failed)


def load_sources(raw: dict[str, DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """Examples of every registered source, and why whole sources failed; see ``load_isolated`` for the rows that failed alone."""
    found = load_isolated(raw)
    return found.examples, found.failed
