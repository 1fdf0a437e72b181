"""Letters and direct answers in model responses, and the gate for explanations, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the letter cascade, in order; the last two look at the
# response's last 600 and 400 characters only.
CASCADE = [
    (r"\\?boxed\s*\{\s*\\?\(?\s*([A-Za-z])\s*\\?\)?\s*\}", None),
    (r"(?i)\\?boxed\s*\{\s*\\?text\s*\{\s*\(?\s*([A-Za-z])\b", None),
    (r"(?i)(?:^|[\s\.,;:!\?\*\(\-])(?:the\s+|my\s+|our\s+|so\s+the\s+|so\s+my\s+)?(?:final|correct|right|best|chosen|selected)?\s*answer(?:\s+is)?\s*[:\-=→]*\s*[\*\s\\]*\(?\s*([A-Za-z])\b", None),
    (r"(?i)(?:^|[\s\.\n\(])(?:option|choice|selection)\s+\*{0,2}\s*\(?\s*([A-Za-z])\s*\)?\s*\*{0,2}\s+(?:is|would|should|appears|seems|matches|fits|will)\b", None),
    (r"(?i)(?:^|[\s\.,;:!\?\*\(\-])\*{0,2}\s*\(?\s*([A-Za-z])\s*\)?\s*\*{0,2}\s+is\s+(?:the\s+)?(?:correct|right|best|true|most\s+correct)\s+(?:answer|choice|option|selection|response)", None),
    (r"\*\*\s*\(?\s*([A-Za-z])\s*[\.\):]\s+[^\*\n]{2,}?\*\*", 600),
    (r"\*\*\s*(?:option\s+|choice\s+)?\(?\s*([A-Za-z])\s*\)?\s*\*\*", 400),
]

# Phrases of refusals, strings no explanation holds, words that affirm a
# two-way answer, and words without content.
REFUSALS = [
    "i cannot answer", "i can't answer", "i do not know", "i don't know", "as an ai", "as a language model",
    "i'm not able to", "i am not able to", "i am sorry, but", "i'm sorry, but",
]
BAD = ["```", "<|endoftext|>", "</s>"]
FAMILY = {
    "yes": ["yes", "correct", "true", "right", "indeed"],
    "no": ["no", "incorrect", "false", "wrong", "isn't", "not"],
    "true": ["true", "yes", "correct", "right"],
    "false": ["false", "no", "incorrect", "wrong"],
}
STOPWORDS = (
    "the a an is are was were be been being and or but of to in on at by for from with as this that these those it its their "
    "if then than so not yes no true false into onto over under above below between among all each any some every only "
    "one two three four five such which who what where when how why do does did has have had "
    "can could would should may might will shall"
).split()


def letter(response: Column) -> Column:
    """The upper-case letter that a response settles on after its thinking; null if there is none.

    The first pattern with a match decides, by its last match; no closing tag gives null."""
    close = F.regexp_instr(response, F.lit("(?i)</think>"))
    after = F.when(close > 0, F.trim(F.substr(response, close + 8, F.length(response))))
    found = []
    for pattern, tail in CASCADE:
        part = after if tail is None else F.right(after, F.lit(tail))
        found.append(F.try_element_at(F.regexp_extract_all(part, F.lit(pattern), 1), F.lit(-1)))
    return F.upper(F.coalesce(*found))


def direct_text(answer: Column) -> Column:
    """A direct answer without its lead-in."""
    bare = F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?iU)^(?:the\s+)?(?:final\s+)?answer\s*(?:is|:)\s*", ""), r"(?U)^\s+|\s+$", "")


def direct_key(answer: Column) -> Column:
    """A direct answer without its lead-in, case, outer punctuation and runs of white space."""
    bare = direct_text(answer)
    return F.regexp_replace(F.regexp_replace(F.lower(bare), r"^[\s\p{Punct}]+|[\s\p{Punct}]+$", ""), r"(?U)\s+", " ")


def direct_match(answer: Column, reference: Column) -> Column:
    """Whether an answer equals the reference, or one of its aliases if that is a JSON list."""
    parsed = F.try_parse_json(reference)
    listed = F.try_variant_get(parsed, "$", "array<string>")
    one = F.coalesce(F.try_variant_get(parsed, "$", "string"), reference)
    aliases = F.coalesce(listed, F.array(one))
    key = direct_key(answer)
    return F.coalesce(F.exists(aliases, lambda a: direct_key(F.coalesce(a, F.lit("None"))) == key), F.lit(False))


def content_words(text: Column) -> Column:
    """Distinct lower-case ASCII words of two characters or more that are no stop word."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 2), F.array(*map(F.lit, STOPWORDS)))


def most_repeats(text: Column, n: int = 3) -> Column:
    """How often the commonest run of n words occurs: the longest run of equal ones after sorting."""
    start = F.struct(F.lit("").alias("gram"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, g: Column) -> Column:
        run = F.when(s["gram"] == g, s["run"] + 1).otherwise(1)
        return F.struct(g.alias("gram"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    def top(words: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) > n, F.aggregate(F.array_sort(grams), start, step, lambda s: s["best"])).otherwise(0)

    # bound to a lambda's variable, the words are split once, not once for each run
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    return F.transform(F.array(words), top)[0]


def mentions(lower: Column, gold: Column, share: float = 0.4, stop_words: bool = True) -> Column:
    """Whether a lower-cased explanation speaks of the gold answer; ``stop_words``: whether a short one without content words is met by its words."""
    g = F.lower(F.trim(gold))
    has = lambda words: reduce(Column.__or__, (lower.contains(w) for w in words))
    parts = F.transform(F.split(gold, ","), lambda p: F.lower(F.trim(p)))
    compound = (F.size(parts) >= 2) & F.forall(parts, lambda p: p.isin(*FAMILY))
    whole = lambda w: F.regexp_like(lower, F.concat(F.lit(r"(?U)\b\Q"), w, F.lit(r"\E\b")))
    words = content_words(gold)
    shared = F.size(F.array_intersect(words, content_words(lower)))
    tokens = F.regexp_extract_all(g, F.lit("[a-z0-9]+"), 0)
    short = F.lit(stop_words) & (F.length(g) <= 30) & (F.size(tokens) > 0) & (F.size(words) == 0)
    loose = (
        lower.contains(g)
        | F.replace(lower, F.lit(" "), F.lit("")).contains(F.replace(g, F.lit(" "), F.lit("")))
        | ((F.size(words) > 0) & (shared >= share * F.size(words)))
        | (short & (F.size(F.filter(tokens, whole)) >= 0.5 * F.size(tokens)))
    )
    out = F.when((g == "") | compound, True)
    for word, family in FAMILY.items():
        out = out.when(g == word, has(family))
    return out.when((F.length(g) <= 3) & g.rlike(r"(?U)^[\p{L}\p{N}]+$"), whole(g)).otherwise(loose)


def gate_reason(explanation: Column, gold: Column, least: int = 200, most: int = 6000, repeats: int = 6, stop_words: bool = True) -> Column:
    """Why an explanation is rejected, by the first rule that fails; null if none does."""
    has = lambda text, words: reduce(Column.__or__, (text.contains(w) for w in words))

    def reason(t: Column) -> Column:
        lower, top = F.lower(t), most_repeats(t)
        return (
            F.when(F.length(t) < least, "too_short")
            .when(F.length(t) > most, "too_long")
            .when(t.rlike(r"^[\[{]"), "list_format_prefix")
            .when(t.rlike(r"""',\s*'|",\s*\""""), "list_format_separator")
            .when(has(lower, REFUSALS), "refusal")
            .when(has(t, BAD), "bad_pattern")
            .when(~mentions(lower, F.coalesce(gold, F.lit("")), stop_words=stop_words), "no_gold_mention")
            .when(top > repeats, F.concat(F.lit("repetitive(reps="), top.cast("string"), F.lit(")")))
        )

    stripped = F.regexp_replace(F.coalesce(explanation, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.transform(F.array(stripped), reason)[0]
