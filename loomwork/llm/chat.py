"""Chat formatting of reply trees.

Messages name the message they reply to.  Self-joins that double the distance
covered tell every message its root, depth and the score of its branch; the
branches of a root are ranked by score, the chosen ones are unrolled into paths
by the same doubled steps, and each path is formatted as one conversation.

The format: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Control
strings inside roles and texts are broken by a backslash after their first
character, backslashes are doubled, and a line break in a role is written ``\\n``,
so the parts can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.workspace import Workspace

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of this and other templates that texts must not hold.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_ESCAPE = re.compile(r"\\(.)", re.S)
#: Characters after which a long conversation goes on in another row, by default.
PIECE_CHARS = 16 << 20


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def reply_paths(messages: DataFrame, work: Workspace, top: int = 1) -> DataFrame:
    """Root-to-leaf paths of the best ``top`` branches of each root.

    Input: id (unique long), parent (long or null), score (double).  Output: path
    (its leaf's id), place (from 1 at the root), id.  A branch scores the sum of its
    messages; ties go to the smaller leaf.  A parent that is no message makes its
    child a root; messages on a cycle have no root and are on no path.  A round writes
    only the messages that had not met their root before it.
    """
    told = messages.select("id", "parent", F.col("score").cast("double").alias("total"))
    ids = told.select(F.col("id").alias("known"))
    first = lambda up, root: ("id", up.alias("up"), F.lit(1).cast("long").alias("depth"), "total", root.alias("root"))
    none = F.lit(None).cast(told.schema["id"].dataType)
    roots = told.where("parent IS NULL").select(*first(none, F.col("id")))
    others = told.where("parent IS NOT NULL").join(ids, F.col("parent") == F.col("known"), "left")
    now = work.save(roots.unionByName(others.select(*first(F.col("known"), F.coalesce("known", "id")))), "jump0")
    met = now.where("up IS NULL")
    parents = now.where("up IS NOT NULL").select(F.col("up").alias("p"))
    leaves = now.join(parents, now["id"] == parents["p"], "left_anti").select(F.col("id").alias("leaf"))
    leaves = work.save(leaves, "leaves")
    left = now.where("up IS NOT NULL").count()
    rounds, limit = 0, left.bit_length() + 1
    while left and rounds < limit:
        other = met.unionByName(now.where("up IS NOT NULL")).select(
            F.col("id").alias("i"), F.col("up").alias("u"), F.col("depth").alias("d"), F.col("total").alias("t"), F.col("root").alias("r")
        )
        rounds += 1
        # only messages that have not met their root take part: no join on a null key
        going = now.where("up IS NOT NULL").join(other, F.col("up") == F.col("i")).select(
            "id", F.col("u").alias("up"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("t")).alias("total"),
            F.col("r").alias("root"),
        )
        now = work.save(going, f"jump{rounds}")
        met, left = met.unionByName(now.where("up IS NULL")), now.where("up IS NOT NULL").count()
    best = Window.partitionBy("root").orderBy(F.desc("total"), "id")
    chosen = (
        met.join(leaves, F.col("id") == F.col("leaf"), "left_semi")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
    )
    paths = work.save(chosen.select(F.col("id").alias("path"), F.col("depth").alias("place"), "id"), f"paths{rounds}")
    for k in reversed(range(rounds)):
        step = now.sparkSession.read.schema(now.schema).parquet(work.at(f"jump{k}"))
        step = step.where("up IS NOT NULL").select(F.col("id").alias("i"), "up")
        more = paths.join(step, F.col("id") == F.col("i")).select("path", (F.col("place") - 2**k).alias("place"), F.col("up").alias("id"))
        paths = work.save(paths.unionByName(more), f"paths{k}")
    return paths


def chain_parents(rows: DataFrame, conv: str, order: list[str], work: Workspace) -> DataFrame:
    """Adds id and parent to rows of linear conversations: each replies to the row before it.

    Rows are sorted over all partitions at once, so that a conversation of any
    length is spread; the first row of a partition looks back to the last of the
    one before.
    """
    keys = [F.col(conv).asc_nulls_first(), *(F.col(c).asc_nulls_last() for c in order)]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = work.save(
        rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id()), "messages"
    )
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    lasts = dealt.groupBy(part.alias("p")).agg(F.max("id").alias("last"))  # a row a partition
    back = lasts.select(F.col("p").alias("bp"), F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("p")).alias("back"))
    lean = dealt.select("id", F.col(conv).alias("c"), part.alias("p")).join(F.broadcast(back), F.col("p") == F.col("bp"))
    lean = lean.select("id", "c", F.when(place > 0, F.col("id") - 1).otherwise(F.col("back")).alias("prior"))
    other = lean.select(F.col("id").alias("o"), F.col("c").alias("oc"))
    links = lean.join(other, (F.col("prior") == F.col("o")) & F.col("c").eqNullSafe(F.col("oc")), "left")
    return dealt.join(links.select("id", F.col("o").alias("parent")), "id")


def format_paths(paths: DataFrame, messages: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One conversation a path: path, piece (from 0), conv_id, text, and the loss mask as
    starts and ends of the assistant's texts within the piece.

    Input messages: id, conv_id, role, text.  Rows stream in path order; a conversation
    of over ``piece_chars`` goes on in further pieces, cut between turns, so that a task
    holds a piece and no more; ``whole_conversations`` makes one row of them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, piece, conv, parts, size, starts, ends = None, 0, None, [], 0, [], []

        def flush() -> dict:
            return {"path": own, "piece": piece, "conv_id": conv, "text": "".join(parts), "starts": starts, "ends": ends}

        for frame in frames:
            out = []
            for path, c, role, text in zip(frame["path"], frame["conv"], frame["role"], frame["text"], strict=True):
                if path != own or size >= piece_chars:
                    if own is not None:
                        out.append(flush())
                    piece = piece + 1 if path == own else 0
                    own, conv, parts, size, starts, ends = path, None if c is None else int(c), [], 0, [], []
                head, body = f"{OPEN}{escape_role(role or '')}\n", escape(text or "")
                if role == "assistant":
                    starts.append(size + len(head))
                    ends.append(size + len(head) + len(body))
                parts += [head, body, CLOSE, "\n"]
                size += len(head) + len(body) + len(CLOSE) + 1
            if out:
                yield _typed(out)
        if own is not None:
            yield _typed([flush()])

    def _typed(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows).assign(conv_id=pd.array([r["conv_id"] for r in rows], "Int64"))

    told = messages.select(F.col("id").alias("m"), F.col("conv_id").cast("string").alias("conv"), "role", "text")
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = paths.join(told, F.col("id") == F.col("m")).repartition(n, "path").sortWithinPartitions("path", "place")
    return dealt.select("path", "conv", "role", "text").mapInPandas(
        run, "path long, piece int, conv_id long, text string, starts array<int>, ends array<int>"
    )


def whole_conversations(formatted: DataFrame) -> DataFrame:
    """One row a path: path, conv_id, text and mask of all its pieces together.  A row holds
    a whole conversation, however long."""
    size = "aggregate(slice(p, 1, i), 0L, (n, x) -> n + length(x.text))"
    moved = lambda name: F.expr(f"flatten(transform(p, (x, i) -> transform(x.{name}, at -> at + {size})))").alias(name)
    pieces = formatted.groupBy("path").agg(
        F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("piece", "text", "starts", "ends"))).alias("p")
    )
    return pieces.select("path", "conv_id", F.array_join("p.text", "").alias("text"), moved("starts"), moved("ends"))


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from their texts and masks alone: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state = None, None

        def row() -> tuple:
            conv, turns, n, loss, chars, size = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)

        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                if r.path != own:
                    if own is not None:
                        rows.append(row())
                    own, state = r.path, [None if r.conv is None else int(r.conv), hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for turn in r.text.split(f"{CLOSE}\n")[:-1]:
                    role, _, text = turn.removeprefix(OPEN).partition("\n")
                    state[1].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                    state[2] += 1
                for a, b in zip(r.starts, r.ends, strict=True):
                    text = unescape(r.text[a:b])
                    state[3].update(text.encode())
                    state[4] += len(text)
                state[5] += len(r.text)
            if rows:
                yield _typed(rows)
        if own is not None:
            yield _typed([row()])

    def _typed(rows: list[tuple]) -> pd.DataFrame:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pd.DataFrame(rows, columns=names).assign(conv_id=pd.array([r[0] for r in rows], "Int64"))

    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = formatted.repartition(n, "path").sortWithinPartitions("path", "piece")
    return dealt.select("path", F.col("conv_id").cast("string").alias("conv"), "text", "starts", "ends").mapInPandas(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def chat_conversations(rows: DataFrame) -> DataFrame:
    """Format linear conversations and read them back.

    Input: conv_id, turn, role, text.  Each row replies to the one before it (by
    turn, null last, then role and text); a conversation is thus a tree of one
    branch.  Null roles and texts are empty; rows with a null conv_id form one
    conversation; repeated rows are turns of their own.  An empty table gives an
    empty result.
    """
    work = Workspace(rows.sparkSession, "chat")
    clean = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    linked = chain_parents(clean, "conv_id", ["turn", "role", "text"], work)
    tree = linked.select("id", "parent", F.length("text").cast("double").alias("score"))
    paths = reply_paths(tree, work)
    messages = work.load("messages", linked.select("conv_id", "turn", "role", "text", "id"))
    return read_formatted(work.save(format_paths(paths, messages), "formatted"))
