"""Terms of whole texts as 64-bit hashes, and filters of hashes of a bounded size.

A term is a run of ASCII letters and digits and of characters beyond ASCII, with A-Z
lower-cased.  Equal terms have equal hashes; two different ones share a hash with
probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.minhash import _mix, _WordHash

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Bytes of text whose terms are held at once; a longer text is held alone.
_RUN = 4 << 20
#: A filter has at most 2 to this power bits: 16 MiB.
_MOST_BITS = 27


def term_runs(texts: pa.Array, known: _WordHash) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of neighbouring texts: the first one's row, the terms' hashes, and where each text's terms end.

    A null text has no terms."""
    words: list[list[bytes]] = []
    first = size = 0
    for i, text in enumerate(texts):
        raw = text.as_py() or b""
        words.append(raw.translate(_TABLE).split())
        size += len(raw)
        if size >= _RUN or i == len(texts) - 1:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
            yield first, np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(ends[-1])), ends
            words, first, size = [], i + 1, 0


def shingle_hashes(terms: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` neighbouring terms."""
    n = max(0, len(terms) - width + 1)
    x = np.full(n, np.uint64(width), np.uint64)
    for i in range(width):
        x = x * np.uint64(0x9E3779B97F4A7C15) + terms[i : i + n]
    return _mix(x)


class HashFilter:
    """Tells hashes that are surely not in a set from those that may be."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.shift = words, np.uint64(64 - bits)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def hash_filter(hashes: DataFrame, n: int) -> HashFilter:
    """The filter of a column ``h`` of ``n`` distinct hashes.

    It has about a thousand bits a hash and never more than 2**27, so what reaches the
    driver and the workers is bounded; beyond that more hashes pass, which a join sorts out."""
    bits = min(_MOST_BITS, max(20, (1024 * max(1, n)).bit_length()))
    at = F.shiftrightunsigned("h", 64 - bits)
    word = F.expr("bit_or(shiftleft(1L, cast(at & 63 AS INT)))")
    found = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(word.alias("set")).toPandas()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found["word"].to_numpy(np.int64)] = found["set"].to_numpy(np.int64).view(np.uint64)
    return HashFilter(words, bits)


def lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """An array of ``n`` lists of values whose rows ascend."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values))
