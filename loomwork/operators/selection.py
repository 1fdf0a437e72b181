"""Selection among sampled responses, and scores of text pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preference_pairs(samples: DataFrame, by: str, loop_chars: int = 8000) -> DataFrame:
    """The longest right response and the first wrong one of each problem, one grouped pass.

    Samples: ``by``, attempt (position), text, letter, right.  A wrong response with a letter
    goes before one without, which counts only below ``loop_chars`` characters.
    Problems that lack either side give no row."""
    right = F.coalesce("right", F.lit(False))
    lettered = ~right & F.col("letter").isNotNull()
    bare = ~right & F.col("letter").isNull() & (F.length("text") < loop_chars)
    per = samples.groupBy(by).agg(
        F.max_by("text", F.when(right, F.struct(F.length("text"), -F.col("attempt")))).alias("chosen"),
        F.min_by("text", F.when(lettered, F.col("attempt"))).alias("_boxed"),
        F.min_by("text", F.when(bare, F.col("attempt"))).alias("_bare"),
    )
    return per.select(by, "chosen", F.coalesce("_boxed", "_bare").alias("rejected")).where("chosen IS NOT NULL AND rejected IS NOT NULL")


def drawn_pairs(samples: DataFrame, by: str, draw: Column, char_cap: int) -> DataFrame:
    """One right and one wrong lettered response of each problem, drawn by ``draw``, and the outcome."""
    right = F.coalesce("right", F.lit(False))
    wrong = ~right & F.col("letter").isNotNull()
    pick = lambda ok: F.min_by("text", F.when(ok, F.struct(draw, F.col("attempt"))))
    per = samples.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(right).alias("n_correct"), pick(right).alias("chosen"), pick(wrong).alias("rejected")
    )
    outcome = (
        F.when(F.col("chosen").isNull(), "no_correct")
        .when(F.col("rejected").isNull(), "no_incorrect")
        .when(F.greatest(F.length("chosen"), F.length("rejected")) > char_cap, "too_long")
        .otherwise("pair")
    )
    return per.withColumn("outcome", outcome)


def first_accepted(samples: DataFrame, by: str) -> DataFrame:
    """The first right response of each problem and the number of tries it took (all, if none is right)."""
    at = F.when(F.coalesce("right", F.lit(False)), F.col("attempt"))
    return samples.groupBy(by).agg(
        F.coalesce(F.min(at) + 1, F.count(F.lit(1))).cast("long").alias("tries"), F.min_by("text", at).alias("accepted")
    )


def token_f1(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """F1 of the token multisets of two texts by pair; two empty texts agree.

    Tokens are counted by pair and side before they meet, so a long text is no long array."""
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    sides = [
        pairs.select(key, F.explode(words(F.col(c))).alias("t"), F.lit(a).alias("a"), F.lit(1 - a).alias("b"))
        for c, a in ((left, 1), (right, 0))
    ]
    per = sides[0].unionByName(sides[1]).groupBy(key, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = per.groupBy(key).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.least("a", "b")).alias("both"))
    f1 = F.when(F.col("na").isNull(), 1.0).otherwise(2.0 * F.col("both") / (F.col("na") + F.col("nb")))
    return pairs.select(key).join(sums, key, "left").select(key, f1.alias("f1"))


def keep_options(options: Column, gold: Column, key: Column, seed: int, k: int) -> Column:
    """The gold option and k - 1 others, drawn and ordered by MD5 of seed, key and option."""
    draw = lambda x: F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), x))
    ranked = F.array_sort(F.transform(options, lambda x: F.struct((x != gold).cast("int").alias("g"), draw(x).alias("h"), x.alias("o"))))
    kept = F.slice(ranked, 1, k)
    return F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["h"].alias("h"), x["o"].alias("o")))), lambda x: x["o"])
