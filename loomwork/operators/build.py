"""Building question sets: distractor pools, more or fewer options, variants, quotas and rebalancing.

Draws are by MD5 of seed and keys, so that every SQL engine draws the same.
"""

from __future__ import annotations

import hashlib
import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import fixed, text
from loomwork.operators.rows import numbered, rank_in
from loomwork.workspace import Workspace


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from hashed parts."""
    digest = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2**32


def offset(n: Column, *parts: Column) -> Column:
    """A whole number in [0, n) from hashed parts."""
    return F.floor(unit(*parts) * n)


def option_pool(questions: DataFrame) -> DataFrame:
    """Distinct options (macro_cat, type, option), an option's first subject with it; blank ones are left out."""
    o = questions.select("macro_cat", F.col("source").alias("subject"), F.explode("options").alias("option"))
    o = o.withColumn("option", F.trim("option")).where("option <> ''").withColumn("type", text.option_type(F.col("option")))
    return o.groupBy("macro_cat", "type", "option").agg(F.min("subject").alias("subject"))


def pool_sizes(pool: DataFrame) -> DataFrame:
    """Options by macro category, and by category and type."""
    sets = pool.groupingSets([[F.col("macro_cat")], [F.col("macro_cat"), F.col("type")]], "macro_cat", "type")
    return sets.agg(F.count(F.lit(1)).alias("n"))


def step_primes(n: int = 64, above: int = 1 << 31) -> list[int]:
    """The first ``n`` primes above a bound: none of them divides a smaller length, so steps of one go round a list of any such length, meeting every place once."""
    small, found, x = [2, 3, 5, 7], [], above | 1  # these bases decide all numbers below 3.2e9

    def prime(m: int) -> bool:
        if any(m % p == 0 for p in small):
            return False
        r = ((m - 1) & -(m - 1)).bit_length() - 1
        return all((y := pow(p, (m - 1) >> r, m)) in (1, m - 1) or any((y := y * y % m) == m - 1 for _ in range(r - 1)) for p in small)

    while len(found) < n:
        if prime(x):
            found.append(x)
        x += 2
    return found


def distractors(questions: DataFrame, pool: DataFrame, seed: int) -> DataFrame:
    """Up to ``need`` further options for each question: qid, place, option.

    Questions: qid, macro_cat, source, options, gold, need.  Tiers: options of the gold's
    type in the question's own subject, then in its macro category, then of any type there;
    a tier with need + 4 options of the gold's length or more keeps to these.  Every list
    is numbered whole in hash order, options that differ in case as one.  A question goes
    through each of its lists in an order of its own, a full cycle of the list by a hashed
    start and a hashed step that has no factor in common with the list's length; so every
    option of a list is as likely as any other, whatever the list's length.  It looks no
    further than it can need: its own options, which are passed over, and ``need`` more.
    So it meets a bounded number of options, by equi-joins on list and place.
    """
    work = Workspace(questions.sparkSession, "distractors")
    blank = F.lit("")
    name = lambda tier, *keys: F.concat_ws("|", F.lit(str(tier)), *(F.coalesce(k, blank) for k in keys))
    tiers = [["macro_cat", "subject", "type"], ["macro_cat", "type"], ["macro_cat"]]
    keyed = lambda tier, extra=(): name(f"{tier}{'n' if extra else 'w'}", *map(F.col, [*tiers[tier], *extra]))
    every = [keyed(t, extra) for t in range(len(tiers)) for extra in (("bucket",), ())]
    listed = pool.withColumn("bucket", text.length_bucket(F.col("option"))).select("option", F.explode(F.array(*every)).alias("list"))
    listed = listed.groupBy("list", F.lower("option").alias("low")).agg(F.min("option").alias("option"))
    order = [F.md5(F.concat_ws("|", F.lit(str(seed)), "low")), F.col("low")]
    listed = work.save(numbered(listed, ["list"], order, "at", "size"), "lists")
    sizes = work.save(listed.where("at = 1").select("list", "size"), "sizes")
    q = questions.select(
        "qid", "macro_cat", F.col("source").alias("subject"), text.option_type(F.col("gold")).alias("type"), text.length_bucket(F.col("gold")).alias("bucket"),
        "need", F.transform("options", lambda o: F.lower(F.trim(o))).alias("own"),
    )
    asked = q.select("qid", "need", "own", F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), keyed(t, ("bucket",)).alias("narrow"), keyed(t).alias("wide")) for t in range(len(tiers))))).alias("t")).select("*", "t.*").drop("t")
    near = sizes.select(F.col("list").alias("narrow"), F.col("size").alias("near"))
    asked = asked.join(near, "narrow", "left").join(sizes.select(F.col("list").alias("wide"), F.col("size").alias("all")), "wide")
    enough = F.coalesce(F.col("near") >= F.col("need") + 4, F.lit(False))
    asked = asked.select("qid", "need", "own", "tier", F.when(enough, F.col("narrow")).otherwise(F.col("wide")).alias("list"), F.when(enough, F.col("near")).otherwise(F.col("all")).alias("size"))
    primes = F.array(*(F.lit(p).cast("long") for p in step_primes()))
    start, which = (offset(n, F.lit(seed), F.col("qid"), F.col("tier"), F.lit(word)) for n, word in ((F.col("size"), "start"), (F.lit(64), "step")))
    places = F.expr("sequence(0L, least(need + size(own), size) - 1L)")
    met = asked.withColumn("start", start).withColumn("by", F.get(primes, which.cast("int"))).select("*", F.explode(places).alias("step"))
    met = met.withColumn("at", F.expr("(start + step * (by % size)) % size + 1")).join(listed.select("list", "at", "low", "option"), ["list", "at"])
    met = met.where(~F.array_contains("own", F.col("low")))
    first = met.groupBy("qid", "need", "low").agg(F.min(F.struct("tier", "step", "option")).alias("x"))
    turn = Window.partitionBy("qid").orderBy("x")
    return first.withColumn("place", F.row_number().over(turn)).where("place <= need").select("qid", "place", F.col("x.option").alias("option"))


def expand(questions: DataFrame, extra: DataFrame, seed: int) -> DataFrame:
    """Questions with the extra options, shuffled by hash: qid, options, gold_idx, k, suffix; k is lower where the pool is short."""
    more = extra.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "option"))).alias("m"))
    q = questions.join(more, "qid").withColumn("options", F.concat("options", F.transform("m", lambda x: x["option"])))
    q = q.withColumn("options", shuffled(F.col("options"), F.col("qid"), seed)).withColumn("k", F.size("options"))
    return q.select("qid", "options", (F.array_position("options", F.col("gold")) - 1).cast("int").alias("gold_idx"), "k", F.concat(F.lit("_aug_exp"), F.col("k").cast("string")).alias("suffix"))


def shuffled(options: Column, key: Column, seed: int) -> Column:
    """Options in the order of hashes of seed, key and option."""
    draw = lambda o: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), o)).alias("h"), o.alias("o"))
    return F.transform(F.array_sort(F.transform(options, draw)), lambda x: x["o"])


def weighted_counts(n: Column, key: Column, seed: int, most: int = 2, weights: dict[int, float] = fixed.EXPAND_WEIGHTS) -> Column:
    """Up to ``most`` distinct option counts above n, drawn by weight in three tries for each."""
    ks = sorted(weights)
    upto = [list(itertools.accumulate(weights[k] for k in ks[i:])) for i in range(len(ks) + 1)]  # by how many counts are too low
    low = F.size(F.filter(F.array(*map(F.lit, ks)), lambda k: k <= n))
    sums = F.get(F.array(*(F.array(*map(F.lit, s)).cast("array<double>") for s in upto)), low)
    total = F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0.0))
    goals = F.transform(F.sequence(F.lit(0), F.lit(3 * most - 1)), lambda i: unit(F.lit(seed), key, i) * total)
    # a try takes the first count whose sum of weights is above its goal
    tries = F.transform(goals, lambda goal: F.get(F.array(*map(F.lit, ks)), low + F.size(F.filter(sums, lambda s: s <= goal))))
    return F.slice(F.array_distinct(F.filter(tries, lambda k: k.isNotNull())), 1, most)


def quota_plan(available: dict[tuple[str, bool], int], total: int, quotas: dict[str, float], augmented_share: float) -> tuple[dict[tuple[str, bool], int], int]:
    """Rows to take of each category's originals and augmented ones, and how many more to fill from the rest.

    A target is its quota of the total, rounded; what rounding leaves goes to the largest
    quota.  Augmented rows stop at their share of the target unless originals are short."""
    target = {m: round(total * q) for m, q in quotas.items()}
    target[max(quotas, key=quotas.get)] += total - sum(target.values())
    take, short = {}, 0
    for macro, goal in target.items():
        originals, variants = (available.get((macro, a), 0) for a in (False, True))
        few = min(round(augmented_share * goal), variants)
        own = min(goal - few, originals)
        few += min(goal - own - few, variants - few)
        take[macro, True], take[macro, False] = few, own
        short += goal - own - few
    return take, short


def quota_sample(df: DataFrame, total: int, quotas: dict[str, float], augmented_share: float, seed: int, key: str = "qid") -> DataFrame:
    """``total`` rows by macro category and is_augmented; what a category lacks is filled from any row left.

    Only counts of the categories reach the driver; rows are cut by rank in each task first."""
    counts = {(r["macro_cat"], r["is_augmented"]): r["count"] for r in df.groupBy("macro_cat", "is_augmented").count().collect()}
    take, short = quota_plan(counts, total, quotas, augmented_share)
    order = [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("is_augmented").cast("string"))), F.col(key)]
    limit = F.lit(0)
    for (macro, augmented), n in take.items():
        limit = F.when((F.col("macro_cat") == macro) & (F.col("is_augmented") == augmented), n).otherwise(limit)
    most = max([*take.values(), 1]) + short
    first = rank_in(df, ["macro_cat", "is_augmented"], order, most, "at").withColumn("limit", limit)
    chosen = first.where("at <= limit").withColumn("filled", F.lit(False))
    rest = first.where("at > limit").orderBy(*order).limit(short).withColumn("filled", F.lit(True))
    return chosen.unionByName(rest).select(*df.columns, "filled")


def choice_shares(low: int, high: int, peak: float, shape: int, edge: float) -> dict[int, float]:
    """The share of each number of choices: a gamma peak and a flat part."""
    weight = {k: k ** (shape - 1) * math.exp(-k * (shape - 1) / peak) for k in range(low, high + 1)}
    return {k: (1 - edge) * w / sum(weight.values()) + edge / len(weight) for k, w in weight.items()}


def rebalance_spans(own: dict[int, int], group: str | None, share: dict[int, float], seed: int) -> list[tuple[int, int, int, int]]:
    """How many rows of each number of choices take each target: (has, first place, last place, target).

    From the largest target down, each takes its share of all rows evenly over the rows
    that have choices enough and are not taken: the rows are thought in line by what they
    have, and every (eligible / wanted)-th is taken from a hashed place on, so each is as
    likely as any other.  In a kind it is the next rows in hash order that are taken."""
    total, used, spans = sum(own.values()), dict.fromkeys(own, 0), []
    for k in sorted(share, reverse=True):
        left = {h: own[h] - used[h] for h in sorted(own) if h >= k and own[h] > used[h]}
        eligible = sum(left.values())
        want = min(int(share[k] * total), eligible)
        if not want:
            continue
        digest = hashlib.md5(f"{seed}|{group or ''}|{k}".encode()).hexdigest()
        start, at, before = int(int(digest[:8], 16) / 2**32 * eligible), 0, 0
        for has, n in left.items():
            at += n
            upto = (at * want - start + eligible - 1) // eligible
            if upto > before:
                spans.append((has, used[has], used[has] + upto - before, k))
                used[has] += upto - before
                before = upto
    return spans


def rebalance(df: DataFrame, by: str, seed: int, low: int = 2, high: int = 20, peak: float = 4.0, shape: int = 4, edge: float = 0.35) -> DataFrame:
    """Questions with as many choices as a mixture of a gamma peak and a flat part wants, by ``by``.

    Input: idx, ``by``, choices (wrong ones; repeated ones count once).  From the largest
    number of choices down, each takes its share of the group's rows, drawn evenly among
    those that have choices enough and are not taken (see ``rebalance_spans``); rows left
    over at the end are in no result.  Output: idx, ``by``, target, kept and ignored
    choices.  Only counts by group and number of choices reach the driver."""
    share = choice_shares(low, high, peak, shape, edge)
    rows = df.withColumn("choices", F.array_distinct("choices")).withColumn("has", F.least(F.size("choices") + 1, F.lit(high)))
    order = [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("idx").cast("string"))), F.col("idx")]
    counts: dict[str | None, dict[int, int]] = {}
    for r in rows.groupBy(by, "has").count().collect():  # a row a group and count
        counts.setdefault(r[by], {})[r["has"]] = r["count"]
    plan = [(group, *span) for group, own in counts.items() for span in rebalance_spans(own, group, share, seed)]
    spans = df.sparkSession.createDataFrame(plan, "group_ string, has_ int, low_ long, high_ long, target int")
    placed = numbered(rows, [by, "has"], order, "at", "n")
    placed = placed.join(F.broadcast(spans), F.col(by).eqNullSafe(F.col("group_")) & (F.col("has") == F.col("has_")) & (F.col("at") > F.col("low_")) & (F.col("at") <= F.col("high_")))
    kept = F.slice("choices", F.lit(1), F.col("target") - 1)
    return placed.select("idx", by, "target", kept.alias("kept"), F.slice("choices", F.col("target"), F.size("choices")).alias("ignored"))


def trivia_options(questions: DataFrame, seed: int, need: int = 3, window: int = 16) -> DataFrame:
    """``need`` wrong answers for each question, from other questions' answers: qid, place, option.

    Questions: qid, gold, aliases.  Answers are numbered in hash order, by type and over all
    types; a question goes round its own type's from a hashed place on, then round the rest.
    An answer that is an alias, holds the gold or is held by it is passed over.  Questions
    meet a window of numbers at first; those left short meet one four times as wide, until
    it is the whole list.  A question that stays short has fewer places.  Questions are dealt
    out before they meet anything, so no task holds more of what is met than it can sort."""
    folded = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))
    kind = text.option_type(F.col("gold")).alias("type")
    pool = questions.select(kind, folded(F.col("gold")).alias("low"), "gold").groupBy("type", "low").agg(F.min("gold").alias("option"))
    order = [F.md5(F.concat_ws("|", F.lit(str(seed)), "low")), F.col("low")]
    work = Workspace(questions.sparkSession, "trivia")
    lists = work.save(
        numbered(pool.withColumn("list", F.col("type")), ["list"], order, "at", "size").unionByName(numbered(pool.withColumn("list", F.lit("")), ["list"], order, "at", "size")),
        "lists",
    )
    sizes = lists.select("list", "size").distinct()
    aliases = F.concat(F.transform("aliases", folded), F.array(folded(F.col("gold"))))
    q = questions.select("qid", kind, folded(F.col("gold")).alias("g"), aliases.alias("aliases"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.col("type").alias("list")), F.struct(F.lit(1).alias("tier"), F.lit("").alias("list"))))
    own = sizes.select(F.col("list").alias("type"), F.col("size").alias("of_type"))
    asked = q.join(own, "type").select("*", both.alias("t")).select("qid", "type", "of_type", "g", "aliases", "t.*").join(sizes, "list")
    asked = work.save(asked.withColumn("start", offset(F.col("size"), F.lit(seed), F.col("qid"), F.col("tier"))), "asked")
    largest = sizes.agg(F.max("size")).first()[0] or 0
    done, todo, step = None, asked, 0
    while True:
        # a question's rows stay in one task from here on, about a million that it meets in each
        parts = -(-todo.count() * min(window, max(largest, 1)) // (1 << 20))
        todo = todo.repartition(max(parts, int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "qid")
        span = F.explode(F.expr(f"sequence(0L, cast(least({window}, size) - 1 AS bigint))"))
        met = todo.select("*", span.alias("step")).withColumn("at", (F.col("start") + F.col("step")) % F.col("size") + 1)
        met = met.join(lists.select("list", "at", F.col("type").alias("kind"), "low", "option"), ["list", "at"])
        good = met.where(~F.array_contains("aliases", F.col("low")) & ~F.col("g").contains(F.col("low")) & ~F.col("low").contains(F.col("g")))
        good = good.where((F.col("tier") == 0) | (F.col("kind") != F.col("type")))
        first = good.groupBy("qid", "low").agg(F.min(F.struct("tier", "step", "option")).alias("x"), F.any_value("of_type").alias("of_type"))
        placed = first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("x"))).where(F.col("place") <= need)
        # a pick of the second tier counts only where the first, the list of the question's type, was seen whole
        whole = F.expr(f"bool_or(x.tier = 1 AND {window} < of_type)")
        placed = work.save(placed.select("qid", "place", "x", "of_type"), f"round{step}")
        per = placed.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), whole.alias("early"))
        full = per.where((F.col("n") == need) & ~F.col("early")).select("qid")
        last = window >= largest
        ready = placed if last else placed.join(full, "qid", "left_semi")
        ready = ready.select("qid", "place", F.col("x.option").alias("option"))
        done = ready if done is None else done.unionByName(ready)
        if last:
            return done
        todo, step, window = work.save(todo.join(full, "qid", "left_anti"), f"todo{step}"), step + 1, window * 4
