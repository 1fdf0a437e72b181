"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?U)^\s+|\s+$"

#: Marks of an image in a text.
IMAGE_MARKER = r"(?i)!\[[^\]]*\]\(|<img|<image_\d+>"


def collapse(text: Column) -> Column:
    """Strip, then collapse white space (Unicode) to one space."""
    return F.regexp_replace(F.regexp_replace(text, _EDGE, ""), r"(?U)\s+", " ")


def stable_uid(text: Column) -> Column:
    """Content key: strip, lower, collapse, first 16 hex digits of SHA-256."""
    stripped = F.lower(F.regexp_replace(text, _EDGE, ""))
    return F.substring(F.sha2(F.regexp_replace(stripped, r"(?U)\s+", " "), 256), 1, 16)


def prompt_key(text: Column) -> Column:
    """SHA-1 of the collapsed, lower-cased prompt."""
    return F.sha1(F.lower(collapse(text)))


def k_bucket(n: Column) -> Column:
    """Number of options as a label; below 2 counts as 2, above 20 as 11-20."""
    return (
        F.when(n <= 2, "2").when(n == 3, "3").when(n == 4, "4").when(n == 5, "5").when(n <= 10, "6-10").otherwise("11-20")
    )


def length_bucket(text: Column) -> Column:
    n = F.length(text)
    return F.when(n <= 15, "S").when(n <= 60, "M").otherwise("L")


def option_type(text: Column) -> Column:
    """year, numeric (with a unit or not), short_entity (at most three words, the first
    capitalised, no comma or final mark) or phrase."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), _EDGE, "")
    number = r"(?U)^[-+]?(\d+\.\d+|\d+/\d+|\d+,\d+|\d+)(\s*(%|[a-zA-Z][a-zA-Z\d/^-]*))?$"
    entity = t.rlike(r"^\p{Lu}") & (F.size(F.split(t, r"(?U)\s+")) <= 3) & ~t.rlike(r"[.?!;]$|,")
    return (
        F.when(t == "", "phrase")
        .when(t.rlike(r"(?U)^(1[0-9]{3}|20[0-9]{2}|2100)$"), "year")
        .when(t.rlike(number), "numeric")
        .when(entity, "short_entity")
        .otherwise("phrase")
    )


def labelled(options: Column, mark: str = ". ") -> Column:
    """Options as lines ``A. x``."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.char(F.lit(65) + i), F.lit(mark), x)), "\n")


def think_strip(text: Column) -> Column:
    """Drop a think block and a leading label, squeeze blank lines."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), _EDGE, "")
    t = F.regexp_replace(t, r"(?iU)^(explanation|reasoning|answer|justification)\s*[:\-]\s*", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), _EDGE, "")


def char_ngrams(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams, runs of white space as one space; a text of n characters or fewer is its own gram.

    Grams are joined from an array of characters: a substring's place is found by a scan of the text."""
    t = F.regexp_replace(text, r"(?U)\s+", " ")

    def grams(c: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*(F.get(c, i + j) for j in range(n))))
        return F.when(F.size(c) <= n, F.array(F.array_join(c, ""))).otherwise(F.array_distinct(whole))

    return F.transform(F.array(F.split(t, "")), grams)[0]
