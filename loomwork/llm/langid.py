"""Language identification: known words first, then ever shorter character n-grams.

A word that was learned scores by its log frequency in each language.  A word
that was not falls back to the longest of its character n-grams that were
learned, each step down costing a fixed discount.

The model is one file in the shared folder, written by a task and mapped by the
workers, so those of one machine share its pages: sorted 64-bit keys of words and
n-grams, and for each key the languages that have it with what its log frequency
there exceeds the log of unseen mass.  What all languages have in common (unseen
mass, discounts) changes neither the best language nor its share, and is left out.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from loomwork.llm.kept import kept, let_go
from loomwork.llm.text import free_names
from loomwork.workspace import Workspace

UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")
_ASCII_LETTERS = re.compile("[a-z]+")
_ALNUM = re.compile(r"[^\W\d_]+")
#: Bytes of words and of scores that a worker keeps at hand, about.
_MEMO_BYTES = 32 << 20
_ALIGN = 64


@dataclass(frozen=True)
class LangIdPlan:
    """sample_rows: about so many labelled rows of each language are learned from,
    drawn by a hash of doc_id and text (a bounded sample; all rows if there are
    fewer).  Every language, word and n-gram of the sample is learned.  longest:
    characters of the longest n-gram.  unseen: share of each language's mass spread
    over all entries, so that a word it lacks costs the same in a large and a small
    language."""

    sample_rows: int = 4000
    longest: int = 5
    unseen: float = 0.01


def tokens(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    text = text.lower()
    if text.isascii():
        return _ASCII_LETTERS.findall(text)
    found = _ALNUM.findall(text)  # letters, and numbers that are no digits
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ([run] if run.isalpha() else _LETTERS.findall(run))]


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def entry_keys(entries: list[str], n: int) -> np.ndarray:
    """64-bit keys of words (n = 0) or n-grams; the length is the hash's seed."""
    key = xxhash.xxh3_64_intdigest
    return np.fromiter((key(e, n) for e in entries), np.uint64, len(entries)).view(np.int64)


def pack(languages: list[str], keys: np.ndarray, kinds: np.ndarray, langs: np.ndarray, counts: np.ndarray, plan: LangIdPlan) -> bytes:
    """A model's file, of parallel rows sorted by key; a kind is an entry's length (0: a word)."""
    width = len(languages)
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    entries = np.bincount(kinds[first], minlength=plan.longest + 1)
    totals = np.bincount(kinds * width + langs, weights=counts, minlength=(plan.longest + 1) * width)
    spread = plan.unseen / np.maximum(entries, 1)[kinds]
    share = counts / totals[kinds * width + langs]
    parts = [keys[first], np.append(first, len(keys)), langs.astype(np.int32), np.log1p((1 - plan.unseen) * share / spread).astype(np.float32)]
    head = json.dumps({"languages": languages, "longest": plan.longest, "sizes": [len(p) for p in parts]}).encode()
    out = [len(head).to_bytes(8, "little") + head]
    for part in parts:
        out.append(b"\0" * (-sum(map(len, out)) % _ALIGN))
        out.append(part.astype(part.dtype.newbyteorder("<")).tobytes())
    return b"".join(out)


class Model:
    """A model with the scores of recent words, one for each worker."""

    def __init__(self, data: np.ndarray):
        size = int.from_bytes(data[:8].tobytes(), "little")
        head = json.loads(data[8 : 8 + size].tobytes())
        self.languages, self.longest = head["languages"], head["longest"]
        at, parts = 8 + size, []
        for n, kind in zip(head["sizes"], ("<i8", "<i8", "<i4", "<f4"), strict=True):
            at += -at % _ALIGN
            end = at + n * np.dtype(kind).itemsize
            parts.append(data[at:end].view(kind))
            at = end
        self.keys, self.starts, self.langs, self.values = parts
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.bytes = 0
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.l, self.v = np.zeros(0, np.int32), np.zeros(0, np.float32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry numbers of the keys, -1 for those not learned."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _expand(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries' languages and values, and how many each has."""
        n = self.starts[entries + 1] - self.starts[entries]
        return np.repeat(self.starts[entries] - np.cumsum(n) + n, n) + np.arange(n.sum()), n

    def learn(self, words: list[str]) -> None:
        """Keep the scores of new words: of the word itself, else the mean of its longest known n-grams."""
        owner, entry, weight = [], [], []
        found = self.find(entry_keys(words, 0))
        known = np.flatnonzero(found >= 0)
        owner.append(known), entry.append(found[known]), weight.append(np.ones(len(known)))
        left = np.flatnonzero(found < 0)
        for n in range(self.longest, 0, -1):
            if not len(left):
                break
            split = [grams_of(words[i], n) for i in left.tolist()]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            found = self.find(entry_keys([g for own in split for g in own], n))
            who = np.repeat(np.arange(len(left)), sizes)[found >= 0]
            hits = np.bincount(who, minlength=len(left))
            owner.append(left[who]), entry.append(found[found >= 0]), weight.append(1 / hits[who])
            left = left[hits == 0]
        owner, entry, weight = map(np.concatenate, (owner, entry, weight))
        order = np.argsort(owner, kind="stable")
        owner, entry, weight = owner[order], entry[order], weight[order]
        places, n = self._expand(entry)
        size = np.bincount(owner, weights=n, minlength=len(words)).astype(np.int64)
        self.slot.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        self.at = np.concatenate([self.at, len(self.l) + np.cumsum(size) - size])
        self.n = np.concatenate([self.n, size])
        self.l = np.concatenate([self.l, self.langs[places]])
        self.v = np.concatenate([self.v, self.values[places] * np.repeat(weight, n).astype(np.float32)])
        self.bytes += sum(map(len, words)) + 120 * len(words) + 8 * len(places)

    def score(self, words: Counter[str]) -> tuple[str, float]:
        """Language and score: the share of the best language's mean likelihood of a word."""
        if not words or not self.languages:
            return UNKNOWN, 0.0
        slots = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        n = self.n[slots]
        places = np.repeat(self.at[slots] - np.cumsum(n) + n, n) + np.arange(n.sum())
        counts = np.repeat(np.fromiter(words.values(), np.float64, len(words)), n)
        mean = np.bincount(self.l[places], weights=self.v[places] * counts, minlength=len(self.languages)) / words.total()
        share = np.exp(mean - mean.max())
        best = int(np.argmax(share))  # ties: the first, languages are sorted
        return self.languages[best], float(share[best] / share.sum())

    def texts(self, texts: list[str | None], group: int = 64) -> Iterator[tuple[str, float]]:
        """The language and score of every whole text."""
        for at in range(0, len(texts), group):
            counted = [Counter(tokens(t)) if isinstance(t, str) else Counter() for t in texts[at : at + group]]
            if self.bytes > _MEMO_BYTES:
                self.clear()
            if new := [w for w in set().union(*counted) if w not in self.slot]:
                self.learn(new)
            yield from map(self.score, counted)


def open_model(name: str, data: Broadcast[bytes]) -> Model:
    """A model, kept for the next task of this worker."""
    return kept(("langid", name), lambda: Model(np.frombuffer(data.value, np.uint8)))


def fit(docs: DataFrame, plan: LangIdPlan = LangIdPlan()) -> bytes:
    """Learn from doc_id, text and lang of the rows where both text and lang are not null.

    Returns the packed model, whose size the bounded sample bounds.  The driver sees it
    and one row a language; words and n-grams are counted in tasks, and one task packs them.
    """
    work = Workspace(docs.sparkSession, "langid")
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("doc_id").alias("id"), "text", "lang")
    seen = work.save(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "languages")
    languages = sorted(r.lang for r in seen.collect())
    at = {lang: i for i, lang in enumerate(languages)}
    draw = F.pmod(F.xxhash64("id", "text", F.lit("sample")), F.lit(1 << 20)) / (1 << 20)
    sample = labelled.join(F.broadcast(seen) if len(languages) <= 10_000 else seen, "lang").where(draw < plan.sample_rows / F.col("rows"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for frame in frames:
            for lang, own in frame.groupby("lang")["text"]:
                found: Counter[str] = Counter()
                for text in own:
                    found.update(tokens(text))
                if found:
                    yield pd.DataFrame({"lang": at[lang], "word": list(found), "n": list(found.values())})

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for frame in frames:
            for lang, own in frame.groupby("lang"):
                words = own["word"].tolist()
                for k in range(plan.longest + 1):
                    found: Counter[str] = Counter()
                    for word, n in zip(words, own["n"], strict=True):
                        for g in grams_of(word, k) if k else (word,):
                            found[g] += n
                    if found:
                        yield pd.DataFrame({"key": entry_keys(list(found), k), "k": k, "lang": lang, "n": list(found.values())})


    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [[c.to_numpy(np.int64) for _, c in frame.items()] for frame in frames]
        keys, kinds, langs, n = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
        yield pd.DataFrame({"model": [pack(languages, keys, kinds, langs, n, plan)]})

    words = sample.select("text", "lang").mapInPandas(count, "lang int, word string, n long")
    words = work.save(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    entries = words.mapInPandas(split, "key long, k int, lang int, n long").groupBy("key", "k", "lang").agg(F.sum("n").alias("n"))
    entries = work.save(entries, "entries")
    made = entries.select("key", "k", "lang", "n").repartition(1).sortWithinPartitions("key", "lang").mapInPandas(write, "model binary")
    row = work.save(made, "model").first()
    work.drop("words", "entries")
    if row is None:  # nothing to learn from, so no task ran
        none = np.zeros(0, np.int64)
        return pack(languages, none, none, none, none, plan)
    return bytes(row["model"])


def predict(docs: DataFrame, model: bytes, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, lang_pred and score of every whole text; only text is looked at.

    One row per input row; a carried column named lang_pred or score ends in ``_``
    (``free_names``).  A null text, or one without a letter, is ``und`` with
    score 0; so is every text if nothing could be learned.  Ties go to the
    language that sorts first.  Repeated rows and null ids are rows like any other.
    An empty table gives an empty result.
    """

    result = ("lang_pred", "score")
    names = free_names(carry, result)
    hidden = free_names(("text",), (*result, *names))[0]
    shared, name = docs.sparkSession.sparkContext.broadcast(model), hashlib.sha256(model).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = open_model(name, shared)
        for batch in batches:
            found = list(own.texts(batch[hidden].to_pylist()))
            columns = [*(batch[c] for c in names), pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *result])

    held = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)), F.col("text").alias(hidden))
    schema = StructType([*(held.schema[n] for n in names), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return held.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
