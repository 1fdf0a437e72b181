"""Equality of mathematical answers, as Column expressions.

Two answers agree if they are equal after one of three normal forms: ``stripped``,
``final`` of the stripped ones, or ``final`` of the answers themselves.  Each form is
a list of rewrites from ``fixed``, folded over the text; a step that looks at its input
more than once is bound to a lambda's variable, so that the plan grows by a node a step.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions import fixed

_EDGE = r"(?U)^\s+|\s+$"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Literal replacements in order."""
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), rules, text)


def _unless(test: Callable[[Column], Column], change: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda t: F.when(test(t), t).otherwise(change(t))


def _last_of(mark: Column) -> Callable[[Column], Column]:
    return lambda t: F.coalesce(F.try_element_at(F.regexp_extract_all(t, mark, 1), F.lit(-1)), t)


def final(answer: Column) -> Column:
    """The answer without units, wrappers, lead-ins, dollar signs and thousands separators."""
    t = rewrite(answer, fixed.FINAL_REWRITES + [(x, "") for x in fixed.FINAL_DROPPED])
    for wrapper in fixed.FINAL_WRAPPERS:
        t = F.regexp_replace(t, "(?d)" + wrapper, "$1")
    for mark in fixed.FINAL_MARKS:
        t = bind(t, _last_of(F.lit("(?d)" + mark)))
    t = F.regexp_replace(t, _EDGE, "")
    t = bind(t, _unless(lambda s: s.contains("\\frac"), lambda s: F.replace(s, F.lit("rac"), F.lit("\\frac"))))
    t = F.regexp_replace(t, r"(?d)frac([^{])(.)", r"frac{$1}{$2}")
    t = F.replace(F.regexp_replace(t, r"sqrt([^{])", r"sqrt{$1}"), F.lit("$"), F.lit(""))
    return bind(t, lambda s: F.when(s.rlike(r"^,*\p{Nd}[\p{Nd},]*$"), F.replace(s, F.lit(","), F.lit(""))).otherwise(s))


def _braced(fraction: Column) -> Column:
    """What follows a fraction mark, with braces around its first two arguments."""
    one, two = F.substr(fraction, F.lit(1), F.lit(1)), F.substr(fraction, F.lit(2), F.lit(1))
    rest = F.substr(fraction, F.lit(3))
    short = F.concat(F.lit("{"), one, F.lit("}"), F.when(two == "{", two).otherwise(F.concat(F.lit("{"), two, F.lit("}"))), rest)
    return F.when(fraction.startswith("{"), fraction).otherwise(short)


def _fractions(t: Column) -> Column:
    parts = F.split(t, r"\\frac")
    after = F.slice(parts, F.lit(2), F.size(parts))
    cut = F.exists(after, lambda p: (F.length(p) < 2) & ~p.startswith("{"))
    return F.when(cut, t).otherwise(F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(after, _braced)), "\\frac"))


def stripped(answer: Column) -> Column:
    """The answer without LaTeX spacing, trailing unit, signs and names, with full fractions."""
    t = F.replace(F.regexp_replace(answer, _EDGE, ""), F.lit("\n"), F.lit(""))
    t = rewrite(F.regexp_replace(t, r"\.+\z", ""), fixed.STRIP_FIRST)

    def unit(s: Column) -> Column:
        return bind(F.regexp_replace(F.regexp_replace(s, r"(?d)\\text\{.*?\}\z", ""), _EDGE, ""), lambda u: F.when(u == "", s).otherwise(u))

    t = rewrite(bind(t, unit), fixed.STRIP_THEN)
    t = bind(t, _unless(lambda s: s.contains("\\infty"), lambda s: F.replace(s, F.lit("inf"), F.lit("\\infty"))))
    t = rewrite(t, [("+\\inity", "\\infty"), ("and", ""), ("\\mathbf", "")])
    t = rewrite(F.regexp_replace(t, r"(?d)\\mbox\{.*?\}", ""), [("'", ""), ('"', "")])
    t = bind(t, _unless(lambda s: s.contains("i"), lambda s: F.replace(s, F.lit("j"), F.lit("i"))))
    t = F.regexp_replace(F.regexp_replace(t, r"(\p{Nd}+)\.0+(\P{Nd})", "$1$2"), r"(\p{Nd}+)\.0+\z", "$1")
    t = F.regexp_replace(t, r"^\.", "0.")
    t = F.regexp_replace(t, r"(?s)^[^=]{0,2}=([^=]*)\z", "$1")
    t = F.replace(F.regexp_replace(t, r"(?U)\\sqrt(\w+)", r"\\sqrt{$1}"), F.lit(" "), F.lit(""))
    t = bind(t, _fractions)
    t = bind(t, lambda s: F.when(s == "0.5", "\\frac{1}{2}").otherwise(s))
    return F.regexp_replace(t, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)\z", r"\\frac{$1}{$2}")


def is_equivalent(left: Column, right: Column) -> Column:
    """Whether two answers agree; two nulls do, one does not."""
    forms = lambda c: bind(stripped(c), lambda s: F.struct(s.alias("s"), final(s).alias("fs")))

    def same(a: Column, b: Column) -> Column:
        return (a["s"] == b["s"]) | (a["fs"] == b["fs"])

    both = bind(F.struct(forms(left).alias("a"), forms(right).alias("b")), lambda x: same(x["a"], x["b"]))
    agree = (left == right) | both | (final(left) == final(right))
    return F.when(left.isNull() & right.isNull(), True).when(left.isNull() | right.isNull(), False).otherwise(agree)
