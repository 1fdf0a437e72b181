"""Assembling the next training corpus from sampled traces, with what became of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import records, responses


def best_traces(samples: DataFrame, shortest: bool = False, most_chars: int = 4000, most_repeats: int = 6) -> DataFrame:
    """What the samples (uid, attempt, completion, gold) of each uid give: uid, n_samples, n_correct, trace.

    A sample is right if the letter after its thinking is its gold letter.  trace (thinking,
    gold, completion) is the first right sample's, or with ``shortest`` the shortest clean
    one's: not too long, no three words too often; null if there is none."""
    told = samples.select(
        "uid", "attempt", "completion", F.upper(F.trim(F.coalesce("gold", F.lit("")))).alias("gold"), responses.letter(F.col("completion")).alias("letter"),
        records.strip(F.substring_index("completion", "</think>", 1)).alias("thinking"),
    ).where("uid IS NOT NULL AND uid <> ''")
    right = F.coalesce(F.col("letter") == F.col("gold"), F.lit(False))
    clean = (F.length("thinking") <= most_chars) & (responses.most_repeats(F.col("thinking")) <= most_repeats)
    order = F.struct(F.length("thinking"), F.col("attempt")) if shortest else F.struct("attempt")
    pick = F.when(right & clean if shortest else right, order)
    return told.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(right).alias("n_correct"), F.min_by(F.struct("thinking", "gold", "completion"), pick).alias("trace")
    )


def assemble(
    rows: DataFrame, samples: DataFrame, tag: str, fallback: bool = True, filtered: bool = False, keep_raw: bool = False, **choice: int | bool
) -> tuple[DataFrame, DataFrame]:
    """(every row with its route and what it became, the rows in no trace's reach as a log).

    Rows: uid, messages (role, content), cot_source and others, which they keep.  Routes:
    replaced (user message and the trace as the assistant's, cot_source = ``tag``), fallback
    (as it was), dropped (no trace, or a trace but no user message), passthrough (never
    tried, kept as some sources were left out: ``filtered``), skipped (never tried, or no
    uid).  Only replaced, fallback and passthrough rows go into the corpus (``kept``).
    The log has uid, gold_letter (null if rows have none) and n_samples of rows that were
    tried without a trace.  ``choice`` goes to ``best_traces``."""
    best = best_traces(samples, **choice)
    known = rows.join(best.withColumnRenamed("uid", "_uid"), F.col("uid") == F.col("_uid"), "left").drop("_uid", "n_correct")
    user = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))
    tried, found = F.col("n_samples").isNotNull(), F.col("trace").isNotNull()
    route = (
        F.when(F.coalesce(F.col("uid"), F.lit("")) == "", "skipped").when(~tried, "passthrough" if filtered else "skipped")
        .when(found & user.isNotNull(), "replaced").when(found, "dropped").otherwise("fallback" if fallback else "dropped")
    )
    known = known.withColumn("route", route)
    new = F.col("route") == "replaced"
    made = records.messages(user["content"], records.reasoned(F.col("trace.thinking"), F.col("trace.gold")))
    out = known.withColumns({
        "messages": F.when(new, made).otherwise(F.col("messages")), "cot_source": F.when(new, F.lit(tag)).otherwise(F.col("cot_source")),
        "kept": F.col("route").isin("replaced", "fallback", "passthrough"),
    })
    if keep_raw:
        out = out.withColumn("raw_completion", F.when(new, F.col("trace.completion")))
    gold = F.col("gold_letter") if "gold_letter" in rows.columns else F.lit(None).cast("string")
    log = known.where(tried & ~found & (F.col("route") != "skipped")).select("uid", gold.alias("gold_letter"), "n_samples")
    return out.drop("trace"), log


def assembly_report(out: DataFrame, *by: str) -> DataFrame:
    """What became of the rows, over all or by some columns: counts of each route, kept, and shares in percent of those tried."""
    count = lambda c: F.count_if(c)
    is_ = lambda *names: F.col("route").isin(*names)
    tried = count(F.col("n_samples").isNotNull() & ~is_("skipped"))
    pct = lambda c: F.round(100.0 * c / F.greatest(tried, F.lit(1)), 2)
    return out.groupBy(*by).agg(
        tried.alias("in_scope"), *(count(is_(r)).alias(r) for r in ("replaced", "fallback", "passthrough", "dropped")),
        count(F.col("kept")).alias("kept"), pct(count(F.col("kept"))).alias("kept_pct"), pct(count(is_("replaced"))).alias("replaced_pct"),
    )
