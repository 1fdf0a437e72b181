"""Answer extraction and scoring as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions import equivalence, responses


def _depths(text: Column) -> Column:
    """1-based end of the braced group that begins ``text``; null if it never closes.

    Most groups hold no other: they end at the first closing brace, before which one is opened.
    Any other text is cut at its closing braces: a cut's depth is what was opened less what was closed."""
    opened = lambda p: F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit("")))
    parts = F.transform(F.split(text, r"\}", -1), lambda p: F.struct(opened(p).alias("opened"), F.length(p).alias("n")))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    step = lambda depth, at, end: F.struct(depth.alias("depth"), at.alias("at"), end.alias("end"))
    walk = lambda cuts: F.aggregate(
        F.slice(cuts, F.lit(1), F.size(cuts) - 1),
        start,
        lambda s, p: F.when(s["end"] > 0, s).otherwise(
            step(s["depth"] + p["opened"] - 1, s["at"] + p["n"] + 1, F.when(s["depth"] + p["opened"] == 1, s["at"] + p["n"] + 1).otherwise(0))
        ),
        lambda s: F.when(s["end"] > 0, s["end"]),
    )
    closed = equivalence.bind(parts, walk)
    first = F.substring_index(text, "}", 1)
    return F.when(~text.contains("}"), None).when(opened(first) == 1, F.length(first) + 1).otherwise(closed)


def boxed(text: Column) -> Column:
    """Content of the last ``\\boxed{...}`` (else the last ``\\fbox{...}``) with balanced braces; else null."""
    mark = F.when(text.contains("\\boxed"), "\\boxed").when(text.contains("\\fbox"), "\\fbox")
    after = F.when(mark == "\\boxed", F.substring_index(text, "\\boxed", -1)).when(
        mark == "\\fbox", F.substring_index(text, "\\fbox", -1)
    )
    return F.transform(F.array(after), lambda a: F.when(a.startswith("{"), F.substr(a, F.lit(2), _depths(a) - 2)))[0]


def boxed_answer(text: Column) -> Column:
    """``boxed`` without a second pair of braces around all of it."""
    return F.regexp_replace(boxed(text), r"(?d)^\{(.*)\}$", "$1")


def own_box(text: Column) -> Column:
    """Stripped content of the last ``\\boxed{`` alone, braces balanced; null if unclosed."""
    after = F.when(text.contains("\\boxed{"), F.concat(F.lit("{"), F.substring_index(text, "\\boxed{", -1)))
    inner = F.transform(F.array(after), lambda a: F.substr(a, F.lit(2), _depths(a) - 2))[0]
    return F.regexp_replace(inner, r"(?U)^\s+|\s+$", "")


def first_box(text: Column) -> Column:
    """What stands between the first ``\\boxed{`` and the next closing brace."""
    found = F.regexp_extract_all(text, F.lit(r"\\boxed\{([^}]*)\}"), 1)
    return F.try_element_at(found, F.lit(1))


def first_letter_box(text: Column) -> Column:
    """The letter of the first ``\\boxed{X}`` with one capital."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"\\boxed\{([A-Z])\}"), 1), F.lit(1))


def last_letter_box(text: Column) -> Column:
    """The letter, upper-cased, of the last ``\\boxed{x}`` with one letter."""
    return F.upper(F.try_element_at(F.regexp_extract_all(text, F.lit(r"\\boxed\{([A-Za-z])\}"), 1), F.lit(-1)))


def choice_label(text: Column) -> Column:
    """A letter that is the whole text, bare or in brackets, or its only stand-alone capital.

    The text is upper-cased first, so lead-ins such as "answer is" decide nothing: "the
    answer is B, not A" has two stand-alone capitals, hence none."""
    t = F.upper(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    whole = F.regexp_extract(t, r"^\(?([A-Z])\)?[.)]?$", 1)
    alone = F.regexp_extract_all(t, F.lit(r"(?U)\b([A-Z])\b"), 1)
    return F.when(whole != "", whole).when(F.size(alone) == 1, F.element_at(alone, 1))


def is_choice(reference: Column) -> Column:
    """Whether a reference is one letter."""
    return F.upper(F.regexp_replace(reference, r"(?U)^\s+|\s+$", "")).rlike("^[A-Z]$")


def extract(text: Column, reference: Column, method: str) -> Column:
    """A response's answer: by its box, as it stands (exact), or, for knowledge, the box or all
    of it read as a choice or a direct answer; another method takes the box or all of it."""
    whole = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    box = boxed_answer(text)
    if method == "boxed":
        return box
    if method == "exact":
        return whole
    either = F.coalesce(box, whole)
    if method != "knowledge":
        return either
    return F.when(is_choice(reference), choice_label(either)).otherwise(responses.direct_text(either))


def correct(extracted: Column, reference: Column, method: str) -> Column:
    """Whether an extracted answer matches the reference; null matches nothing."""
    if method == "knowledge":
        letter = F.upper(extracted) == F.upper(F.regexp_replace(reference, r"(?U)^\s+|\s+$", ""))
        right = F.when(is_choice(reference), letter).otherwise(responses.direct_match(extracted, reference))
    else:
        both = F.struct(equivalence.final(extracted).alias("l"), equivalence.final(reference).alias("r"))  # made once, however often compared
        right = equivalence.bind(both, lambda x: equivalence.is_equivalent(x["l"], x["r"]))
    return extracted.isNotNull() & F.coalesce(right, F.lit(False))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased chance that one of k drawn samples is right."""
    product = F.aggregate(
        F.sequence((n - c + 1).cast("long"), n.cast("long")), F.lit(1.0), lambda a, i: a * (1 - F.lit(float(k)) / i)
    )
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1.0 - product)


def reward(correct: Column, boxed_: Column, overlong: Column) -> Column:
    """1 for a right answer, else -0.25 boxed or -0.75 not; 0.05 less if overlong."""
    base = F.when(correct, 1.0).when(boxed_, -0.25).otherwise(-0.75)
    return base - F.when(overlong, 0.05).otherwise(0.0)
