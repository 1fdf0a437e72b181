"""Byte-level BPE encoding and decoding by two-tier lookup.

A pre-token that is itself in the vocabulary is found by a minimal perfect hash
(hash and displace, checked against the stored bytes); only the others are
merged, with a heap of ranked pairs over a linked list of byte pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.kept import kept

_MASK = (1 << 64) - 1
#: Bytes of pieces of text, and of pre-tokens, whose ids a worker keeps at hand, about.
_MEMO_BYTES = 40 << 20
_TOKEN_BYTES = 120 << 20
_ENTRY = 200
#: Longer pieces and pre-tokens are not kept.
_LONG = 64


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: base64 and number on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def _slots(hashes: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    """Slot of each hash under its bucket's displacement."""
    x = hashes ^ (shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct byte strings onto 0..n-1, with their ids.

    Keys fall into buckets of about four; the largest buckets choose first a
    displacement that sends all their keys to free slots.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.n, keys = len(ranks), list(ranks)
        self.buckets = max(1, self.n // 4)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, self.n)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        self.shift = np.zeros(self.buckets, np.uint32)
        free = np.ones(self.n, bool)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(edges)
        place = np.zeros(self.n, np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[edges[b] : edges[b + 1]]
            if not len(own):
                break
            first = 0
            while True:
                tries = np.arange(first, first + 256)
                slots = _slots(np.repeat(hashes[own][None], 256, 0), np.repeat(tries[:, None], len(own), 1), self.n)
                good = free[slots].all(1)
                if len(own) > 1:
                    good &= (np.diff(np.sort(slots, 1), axis=1) > 0).all(1)
                if good.any():
                    t = int(np.argmax(good))
                    break
                first += 256
            self.shift[b] = tries[t]
            free[slots[t]] = False
            place[own] = slots[t]
        self.keys: list[bytes] = [b""] * self.n
        self.ids = np.zeros(self.n, np.uint32)
        for k, s in zip(keys, place.tolist(), strict=True):
            self.keys[s] = k
            self.ids[s] = ranks[k]

    def find(self, tokens: list[bytes]) -> list[int]:
        """Ids of the tokens, -1 for those not among the keys."""
        if not self.n or not tokens:
            return [-1] * len(tokens)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = _slots(hashes, shift, self.n).tolist()
        ids = self.ids
        return [int(ids[s]) if self.keys[s] == t else -1 for t, s in zip(tokens, slots, strict=True)]


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """Id of every pair of ids that joins: key left << 20 | right."""
    pairs = {}
    for token, joined in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pairs[left << 20 | right] = joined
    return pairs


def merge(token: bytes, single: list[int], pairs: dict[int, int]) -> list[int]:
    """Ids of one pre-token: always the lowest-ranked pair of neighbours joins, the leftmost first.

    Pieces are nodes of a linked list over the bytes, each with its id; the heap
    holds pairs as rank << bits | place, and a popped pair counts only if the
    pieces now at its place still join to that rank.
    """
    n = len(token)
    bits, join = n.bit_length(), pairs.get
    low = (1 << bits) - 1
    ids = [single[b] for b in token]
    heap = [r << bits | i for i, (a, b) in enumerate(itertools.pairwise(ids)) if (r := join(a << 20 | b)) is not None]
    if not heap:
        return ids
    prev, follow = list(range(-1, n - 1)), list(range(1, n + 1))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        i = top & low
        left, j = ids[i], follow[i]
        if left < 0 or j >= n or join(left << 20 | ids[j]) != top >> bits:
            continue
        ids[i] = left = top >> bits
        ids[j] = -1
        follow[i] = k = follow[j]
        if k < n:
            prev[k] = i
            if (r := join(left << 20 | ids[k])) is not None:
                push(heap, r << bits | i)
        if (h := prev[i]) >= 0 and (r := join(ids[h] << 20 | left)) is not None:
            push(heap, r << bits | h)
    return [i for i in ids if i >= 0]


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class ByteBpe:
    """Encoder and decoder over ranks, one for each worker."""

    #: A space before a character that is not white space always begins a match of
    #: the pattern, so texts are cut there and equal pieces are encoded once.
    _cut = re.compile(r" (?=\S)")

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: PerfectHash):
        self.table, self.pairs = table, pair_table(ranks)
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(pattern).findall
        if pattern != public_tokenizers.PATTERN:  # another may join what stands on both sides of a cut
            self._cut = None
        vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            vocabulary[i] = token
        self.vocabulary = pa.array(vocabulary, pa.large_binary())
        self.memo: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}
        self.memo_bytes = self.token_bytes = 0

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces; pre-tokens of ordinary length are kept."""
        if self.token_bytes > _TOKEN_BYTES:
            self.tokens, self.token_bytes = {}, 0
        split = [self.split(p) for p in pieces]
        known = self.tokens
        distinct = list({t for own in split for t in own if t not in known})
        coded = [t.encode() for t in distinct]
        for t, b, i in zip(distinct, coded, self.table.find(coded), strict=True):
            known[t] = i.to_bytes(4, "little") if i >= 0 else _packed(merge(b, self.single, self.pairs))
        self.token_bytes += sum(map(len, coded)) * 2 + _ENTRY * len(distinct)
        out = {piece: b"".join([known[t] for t in own]) for piece, own in zip(pieces, split, strict=True)}
        for t in distinct:
            if len(t) > _LONG:
                del known[t]
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut, out = self._cut.split if self._cut else lambda text: [text], []
        for at in range(0, len(texts), 64):
            split = []
            for text in texts[at : at + 64]:
                pieces = cut(text)
                pieces[1:] = map(" ".__add__, pieces[1:])
                split.append(pieces)
            if self.memo_bytes > _MEMO_BYTES:
                self.memo, self.memo_bytes = {}, 0
            memo = self.memo
            new = [p for p in set().union(*split) if p not in memo]
            memo.update(self._learn(new))
            self.memo_bytes += sum(map(len, new)) * 3 + _ENTRY * len(new)
            out += [b"".join(map(memo.__getitem__, pieces)) for pieces in split]
            for p in new:
                if len(p) > _LONG:
                    del memo[p]
        return out

    def decode(self, ids: bytes) -> memoryview:
        """Bytes of the ids' tokens: taken one after another, they lie so in memory."""
        taken = self.vocabulary.take(pa.array(np.frombuffer(ids, "<u4")))
        ends, data = np.frombuffer(taken.buffers()[1], np.int64), taken.buffers()[2]
        return memoryview(data or b"")[ends[taken.offset] : ends[taken.offset + len(taken)]]


def encode_documents(docs: DataFrame, ranks_file: bytes, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode whole texts and decode them again.

    Input: doc_id and text; other columns are ignored.  Output, one row per input
    row: doc_id, n_tokens long, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), decoded_sha256 (of the decoded bytes), and with ``keep_ids``
    the ids as an array.  A null text is empty: no ids.  Repeated rows are encoded
    each; an empty table gives an empty result.  The rank file (at most 16 MiB, a
    vocabulary and not data) goes to the workers with the plan.
    """
    if len(ranks_file) > 16 << 20:
        raise ValueError("a rank file of over 16 MiB is not sent to the workers")
    ranks = load_ranks(ranks_file)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, PerfectHash(ranks)))
    name = hashlib.sha256(ranks_file).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept(("bytes", name, pattern), lambda: ByteBpe(shared.value[0], pattern, shared.value[1]))
        for batch in batches:
            coded = bpe.encode_batch([t or "" for t in batch["text"].to_pylist()])
            columns = [
                batch["doc_id"],
                pa.array([len(ids) // 4 for ids in coded], pa.int64()),
                pa.array([hashlib.sha256(ids).hexdigest() for ids in coded]),
                pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in coded]),
            ]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(ids, "<i4") for ids in coded], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
