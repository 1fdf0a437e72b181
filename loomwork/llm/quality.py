"""Distribution-divergence quality rules, as DataFrame expressions only.

Every language gets a reference from all its documents: the shares of six
character classes and of its most common words.  A document whose own
histograms lie too far from its language's reference (Jensen-Shannon distance,
base 2) is rejected; too short a text is not judged by that histogram.  A
histogram of n words lies away from its reference by chance alone: about
(bins - 1) / (8 n ln 2) in squared distance, which is taken off first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.text import free_names, words
from loomwork.workspace import Workspace

CLASSES = ("lower", "upper", "digit", "space", "point")
#: What is neither a lower-case letter nor white space is little of a text; the other classes are counted in it.
_COMMON = r"[\p{Ll} \t-\r]+"
_CLASS_COMPLEMENT = {"upper": r"[^\p{Lu}]+", "digit": r"[^\p{Nd}]+", "point": r"[^.,;:!?'\"()\-]+"}
_SLOTS = 256


@dataclass(frozen=True)
class QualityRules:
    """Parameters of the rules.

    common_words: words in a language's reference, with those tied with the last;
    each has at least min_share_per_mille of the language's words, which bounds
    their number.  min_chars, min_words: texts with fewer are not judged by that
    histogram.  max_char_distance,
    max_word_distance: largest Jensen-Shannon distance that is kept.
    min_reference_words: a language with fewer words in all has no reference,
    and its documents are not judged by divergence.
    """

    window: int = 8
    base_min_words: int = 20
    base_max_repeat_percent: int = 30
    common_words: int = 50
    min_chars: int = 100
    min_words: int = 50
    max_char_distance: float = 0.30
    max_word_distance: float = 0.30
    min_reference_words: int = 1000
    min_share_per_mille: int = 1


def _with_counts(docs: DataFrame, row: Column) -> DataFrame:
    """Counts of each text beside ``row``, what the caller keeps of the input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(row.alias("row"), "lang", text.alias("text"), words(F.col("text")).alias("words"))
    df = df.select(
        "row",
        "lang",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.length("text").cast("long").alias("n_chars"),
        F.regexp_replace("text", _COMMON, "").alias("rest"),
    )
    counts = {f"c_{name}": F.length(F.regexp_replace("rest", others, "")).cast("long") for name, others in _CLASS_COMPLEMENT.items()}
    counts["c_space"] = F.col("n_chars") - F.col("word_chars")  # words are runs of all else
    counts["c_lower"] = F.col("word_chars") - F.length("rest")
    return df.withColumns(counts)


def _repeats(df: DataFrame, k: int) -> DataFrame:
    """Adds n_repeat_words: words within k-word windows that occur twice or more."""
    df = df.withColumn(
        "windows",
        F.expr(
            f"CASE WHEN size(hashes) > {k} THEN transform(sequence(1, size(hashes) - {k - 1}),"
            f" i -> xxhash64(slice(hashes, i, {k}))) ELSE array() END"
        ),
    )
    df = df.withColumn("repeated", F.expr("size(array_distinct(windows)) < size(windows)"))
    df = df.withColumn(
        "sorted",
        F.expr("CASE WHEN repeated THEN sort_array(transform(windows, (x, i) -> named_struct('h', x, 'p', i))) END"),
    )
    df = df.withColumn(
        "places",
        F.expr(
            "CASE WHEN repeated THEN sort_array(filter(transform(sorted, (x, k) -> CASE WHEN"
            " x.h <=> get(sorted, k - 1).h OR x.h <=> get(sorted, k + 1).h THEN x.p END), p -> p IS NOT NULL)) END"
        ),
    )
    total = F.expr(
        f"aggregate(places, named_struct('n', 0L, 'last', -{k}),"
        f" (a, p) -> named_struct('n', a.n + least({k}, p - a.last), 'last', p), a -> a.n)"
    )
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop(
        "windows", "repeated", "sorted", "places"
    )


def _shares(prefix: str) -> list[Column]:
    known = [F.col(f"{prefix}_{c}") for c in CLASSES]
    rest = F.col("n_chars" if prefix == "c" else f"{prefix}_chars")
    for c in known:
        rest = rest - c
    return [*known, rest]


def _half_terms(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    side = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (side(p) + side(q)) / 2


def references(docs: DataFrame, rules: QualityRules, work: Workspace) -> DataFrame:
    """One row a language: character-class sums and a hash table of its common words.

    A language without a common word has an empty table; its characters are still compared.

    The words are counted over all documents, summed in each task before the
    shuffle; the top words of a language are cut in each task before they meet.
    """
    counted = _with_counts(docs, F.lit(0)).where(F.col("lang").isNotNull())
    sums = counted.groupBy("lang").agg(
        F.sum("n_words").alias("r_words"),
        F.sum("n_chars").alias("r_chars"),
        *(F.sum(f"c_{c}").alias(f"r_{c}") for c in CLASSES),
    )
    tokens = docs.where(F.col("lang").isNotNull()).select(
        "lang", F.explode(F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).alias("h")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"))
    top = (
        tokens.groupBy("lang", "h")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("rank", F.rank().over(order))
        .where(F.col("rank") <= rules.common_words)
    )
    sums = work.save(sums.where(F.col("r_words") >= rules.min_reference_words).coalesce(1), "sums")  # a row a language, read twice
    top = top.join(sums.select("lang", "r_words"), "lang").where(
        F.col("n") * 1000 >= F.col("r_words") * rules.min_share_per_mille
    )
    table = (
        top.groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("n", "h")), asc=False).alias("top"))
        .select(
            "lang",
            F.expr("transform(top, (t, i) -> named_struct('rank', i + 1, 'h', t.h, 'n', t.n))").alias("top"),
        )
        .select(
            "lang",
            F.expr("transform(top, t -> t.n)").alias("top_n"),
            F.expr(
                f"transform(sequence(0, {_SLOTS - 1}), s -> transform(filter(top, t -> pmod(t.h, {_SLOTS}) = s), t -> t.h))"
            ).alias("slot_hashes"),
            F.expr(
                f"transform(sequence(0, {_SLOTS - 1}), s -> transform(filter(top, t -> pmod(t.h, {_SLOTS}) = s), t -> t.rank))"
            ).alias("slot_ranks"),
        )
    )
    none = lambda of: F.array_repeat(F.expr(f"cast(array() as array<{of}>)"), _SLOTS)
    made = sums.join(table, "lang", "left").select(
        *sums.columns,
        F.coalesce("top_n", F.expr("cast(array() as array<bigint>)")).alias("top_n"),
        F.coalesce("slot_hashes", none("bigint")).alias("slot_hashes"),
        F.coalesce("slot_ranks", none("int")).alias("slot_ranks"),
    )
    return work.save(made.withColumnRenamed("lang", "r_lang").coalesce(1), "references")


_RESULT = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance",
)


def distribution_quality(docs: DataFrame, rules: QualityRules = QualityRules(), carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, distances and verdict of every document.

    Input: text, lang and the columns ``carry``; others are ignored.  Output, one row
    per input row: the columns ``carry`` (doc_id), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed, kept (boolean), char_distance,
    word_distance (double; null where not judged).  A carried column named as one of
    these ends in ``_`` (``free_names``).  A null text counts as
    empty: no words, so base_failed.  A null lang, or a language without a
    reference, is not judged by divergence.  Repeated rows give repeated rows;
    an empty table gives an empty result.  Windows are compared by 64-bit
    hashes within one document.

    The decisions are a few numbers a document, written and read again: a filter on
    them must not be pushed into the expressions they come from.  The references are
    one row a language, written and read again, so that the
    join is a broadcast only if the file's size is below Spark's threshold.
    """
    work = Workspace(docs.sparkSession, "quality")
    refs = references(docs, rules, work)
    df = _repeats(_with_counts(docs, F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(carry, free_names(carry, _RESULT), strict=True)))), rules.window)
    df = df.withColumn(
        "n_symbols", F.length(F.regexp_replace("rest", r"[^#*$%&|<>]+", ""))
    ).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    df = df.select(
        "row", "lang", "n_words", "word_chars", F.col("n_symbols").cast("long").alias("n_symbols"),
        "n_dup_lines", "n_repeat_words", "n_chars", *(f"c_{c}" for c in CLASSES), "hashes",
    )
    df = df.join(refs, F.col("lang") == F.col("r_lang"), "left")
    char = F.lit(0.0)
    for c, r in zip(_shares("c"), _shares("r"), strict=True):
        char = char + _half_terms(c / F.col("n_chars"), r / F.col("r_chars"))
    chance = lambda bins: (bins - 1) / (8 * math.log(2) * F.col("n_words"))
    df = df.withColumn(
        "char_distance",
        F.when(
            (F.col("n_chars") >= rules.min_chars) & (F.col("n_words") > 0) & (F.col("r_chars") > 0),
            F.sqrt(F.greatest(char - chance(F.lit(len(CLASSES) + 1)), F.lit(0.0))),
        ),
    )
    df = df.withColumn(
        "hits",
        F.expr(
            f"CASE WHEN r_words IS NOT NULL AND n_words >= {rules.min_words} THEN sort_array(filter(transform(hashes,"
            f" h -> get(slot_ranks[pmod(h, {_SLOTS})], cast(array_position(slot_hashes[pmod(h, {_SLOTS})], h) as int) - 1)),"
            " r -> r IS NOT NULL)) END"
        ),
    )
    df = df.withColumn(
        "runs",
        F.expr(
            "filter(transform(hits, (r, i) -> CASE WHEN NOT r <=> get(hits, i - 1) THEN named_struct('r', r, 'at', i) END),"
            " x -> x IS NOT NULL)"
        ),
    )
    term = "(CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({p} + {q})) ELSE 0.0D END)"
    both = lambda p, q: f"({term.format(x=p, p=p, q=q)} + {term.format(x=q, p=p, q=q)}) / 2"
    df = df.withColumn(
        "bins",
        F.expr(
            "transform(runs, (x, i) -> named_struct("
            "'p', (coalesce(get(runs, i + 1).at, size(hits)) - x.at) / n_words, 'q', top_n[x.r - 1] / r_words))"
        ),
    ).withColumn("rest_p", F.expr("(n_words - size(hits)) / n_words")).withColumn(
        "rest_q", F.expr("(r_words - aggregate(top_n, 0L, (a, n) -> a + n)) / r_words")
    )
    unseen = "(aggregate(top_n, 0L, (a, n) -> a + n) / r_words - aggregate(bins, 0.0D, (a, b) -> a + b.q)) / 2"
    word = f"aggregate(bins, 0.0D, (a, b) -> a + {both('b.p', 'b.q')}) + {unseen} + {both('rest_p', 'rest_q')}"
    df = df.withColumn("word_distance", F.sqrt(F.greatest(F.expr(word) - chance(F.size("top_n") + 1), F.lit(0.0))))
    failed = (F.col("n_words") < rules.base_min_words) | (
        100 * F.col("n_repeat_words") > rules.base_max_repeat_percent * F.col("n_words")
    )
    near = F.coalesce(F.col("char_distance") <= rules.max_char_distance, F.lit(True)) & F.coalesce(
        F.col("word_distance") <= rules.max_word_distance, F.lit(True)
    )
    out = df.select(
        "row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & near).alias("kept"), "char_distance", "word_distance",
    )
    return work.save(out, "decisions")
