"""Fields, messages and prompts of training records, and the small texts that drivers parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import fixed

_EDGE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def stem(prompt: Column) -> Column:
    """A prompt before its list of choices."""
    return F.substring_index(F.substring_index(prompt, "\n\nChoices:", 1), "\nChoices:", 1)


def parse_lettered(prompt: Column, answer: Column) -> Column:
    """struct(question, gold, others) of a prompt whose options are lines ``A) x`` after a blank line."""
    parts = F.split(prompt, r"\n\nA\)")
    lines = F.filter(F.split(F.concat(F.lit("A)"), strip(parts[1])), "\n"), lambda x: strip(x) != "")
    options = F.transform(lines, lambda x: F.struct(F.substr(x, F.lit(1), F.lit(1)).alias("letter"), strip(F.substr(x, F.lit(3))).alias("text")))

    def told(o: Column) -> Column:
        gold = F.filter(o, lambda x: x["letter"] == answer)
        others = F.transform(F.filter(o, lambda x: x["letter"] != answer), lambda x: x["text"])
        return F.struct(strip(parts[0]).alias("question"), F.get(gold, F.lit(0))["text"].alias("gold"), others.alias("others"))

    return F.transform(F.array(options), told)[0]


def is_binary(gold: Column) -> Column:
    """yes, no, true or false, or some of them between commas."""
    return F.forall(F.split(gold, ","), lambda p: F.lower(strip(p)).isin("yes", "no", "true", "false"))


def style_of(source: Column, override: str | None = None) -> Column:
    """long for the sources whose explanations are, else short; an override wins unless it is auto."""
    if override and override != "auto":
        return F.lit(override)
    return F.when(source.isin(fixed.LONG_SOURCES), "long").otherwise("short")


def least_chars(source: Column, style: Column) -> Column:
    """Least length of an explanation: by style, by source where the style is none of the known."""
    by_source = F.when(source.isin(fixed.LONG_SOURCES), fixed.LEAST_LONG).otherwise(fixed.LEAST_SHORT)
    return F.when(style.isin("long", "contrastive"), fixed.LEAST_LONG).when(style == "short", fixed.LEAST_SHORT).otherwise(by_source)


def teacher_prompt(question: Column, gold: Column, style: Column, templates: dict[tuple[str, bool], str]) -> Column:
    """The template of the style, for a two-way gold or not, with its ``{question}`` and ``{gold}`` filled in."""
    out = F.lit(None).cast("string")
    two = is_binary(strip(gold))
    for (name, binary), template in templates.items():
        filled = F.replace(F.replace(F.lit(template), F.lit("{gold}"), strip(gold)), F.lit("{question}"), strip(question))
        out = F.when((style == name) & (two if binary else ~two), filled).otherwise(out)
    return out


def boxed_line(line: str, answer: Column) -> Column:
    before, after = line.split("%s")
    return F.concat(F.lit(before), answer, F.lit(after))


def reasoned(reasoning: Column, letter: Column) -> Column:
    """Reasoning between thinking tags, then the answer's line."""
    return F.concat(F.lit("<think>\n"), strip(reasoning), F.lit("\n</think>\n\n"), boxed_line(fixed.ANSWER_LINE, letter))


def made_up(gold: Column, letter: Column) -> Column:
    """A sentence in place of a missing explanation."""
    return F.concat(F.lit('Among the options, the one that best matches the question is "'), strip(gold), F.lit('", which is option '), letter, F.lit("."))


def messages(user: Column, assistant: Column, system: Column | None = None) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    first = [] if system is None else [turn("system", system)]
    return F.array(*first, turn("user", user), turn("assistant", assistant))


def message_text(given: Column) -> Column:
    """The contents of a list of messages, one after another; a null content is empty."""
    return F.array_join(F.transform(given, lambda m: F.coalesce(m["content"], F.lit(""))), "")


def without_last(given: Column) -> Column:
    return F.slice(given, F.lit(1), F.greatest(F.size(given) - 1, F.lit(0)))


def language_of(idx: Column) -> Column:
    """What stands before the first underscore; two letters where there is none."""
    return F.when(idx.contains("_"), F.substring_index(idx, "_", 1)).otherwise(F.substr(idx, F.lit(1), F.lit(2)))


def safe_name(text: Column) -> Column:
    """A file name: runs of other characters than letters, digits, dot, dash and underscore are one underscore."""
    name = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(name == "", "unknown").otherwise(name)


def number_tag(value: Column) -> Column:
    """A number in a file name: p for the point."""
    return F.replace(value.cast("string"), F.lit("."), F.lit("p"))


def present_field(df: DataFrame, fields: list[str]) -> str:
    """The first of ``fields`` with any value that is neither null nor empty; none is an error."""
    flags = df.agg(*(F.max((F.coalesce(F.col(f).cast("string"), F.lit("")) != "").cast("int")).alias(f) for f in fields)).first()
    for f in fields:
        if flags[f]:
            return f
    raise ValueError(f"none of {', '.join(fields)} has a value")


def count_spec(spec: str) -> set[int]:
    """Numbers of a text such as ``1-7,9``."""
    found: set[int] = set()
    for part in filter(None, map(str.strip, spec.split(","))):
        low, dash, high = part.partition("-")
        found |= set(range(int(low), int(high) + 1)) if dash and low else {int(part)}
    if any(n < 0 for n in found):
        raise ValueError("counts must not be negative")
    return found


def quota_spec(spec: str | None) -> dict[str, float]:
    """Quotas of a text such as ``stem=0.25,law=0.2``, scaled to a sum of one; defaults without any."""
    if not spec:
        return dict(fixed.MACRO_QUOTAS)
    pairs = [p.split("=") for p in spec.split(",") if p.strip()]
    quotas = {k.strip(): float(v) for k, v in pairs}
    total = sum(quotas.values())
    return quotas if abs(total - 1) <= 1e-3 else {k: v / total for k, v in quotas.items()}


def limit_spec(values: list[str]) -> dict[str, int]:
    """Limits of texts such as ``source=100``."""
    out = {}
    for value in values:
        name, equal, n = value.partition("=")
        if not equal:
            raise ValueError(f"expected source=number, not {value!r}")
        out[name] = int(n)
    return out
