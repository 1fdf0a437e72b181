"""Token counts by a tokenizer, batch by batch."""

from __future__ import annotations

import json
import os
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Bytes of pieces whose counts a worker keeps at hand, about, and what an entry takes besides.
_MEMO_BYTES = 64 << 20
_ENTRY = 180
#: Longer pieces are not kept.
_LONG = 64
#: The byte-level pre-tokenizer begins a match at every space before a word character.
_CUT = re.compile(r" (?=\w)")
_CUTS_AT_SPACES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

_loaded: dict[str, Counter] = {}


class Counter:
    """Counts tokens, those of equal pieces once.

    A byte-level tokenizer without a normalizer or special tokens lets no token cross a
    space before a word character, so a text has as many tokens as its pieces have; texts
    go whole to a tokenizer of another form."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True
        form = json.loads(definition)
        whole = any(form.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
        plain = all(t.get("special") for t in form.get("added_tokens") or [])
        self.cuts = not whole and plain and form.get("pre_tokenizer") == _CUTS_AT_SPACES and not form["model"].get("dropout")
        self.memo: dict[str, int] = {}
        self.room = _MEMO_BYTES

    def _ask(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return self._ask(texts)
        split = []
        for text in texts:
            pieces = _CUT.split(text)
            pieces[1:] = map(" ".__add__, pieces[1:])
            split.append(pieces)
        if self.room < 0:
            self.memo, self.room = {}, _MEMO_BYTES
        memo = self.memo
        new = [p for p in set().union(*split) if p not in memo]
        memo.update(zip(new, self._ask(new), strict=True))
        self.room -= sum(map(len, new)) + _ENTRY * len(new)
        out = [sum(map(memo.__getitem__, pieces)) for pieces in split]
        for p in new:
            if len(p) > _LONG:
                del memo[p]
        return out


def token_count(text: Column, tokenizer: str) -> Column:
    """Tokens of each text without special ones, by a tokenizer given as its JSON definition; null has none.

    A worker builds the tokenizer once; texts are encoded a few at a time, so what is held
    is bounded by the texts of a batch and by what a ``Counter`` keeps."""

    def count(texts: pd.Series) -> pd.Series:
        if tokenizer not in _loaded:
            _loaded.clear()
            _loaded[tokenizer] = Counter(tokenizer)
        out = []
        for at in range(0, len(texts), 64):
            out += _loaded[tokenizer]([t if isinstance(t, str) else "" for t in texts.iloc[at : at + 64]])
        return pd.Series(out, index=texts.index, dtype="int64")

    return F.pandas_udf(count, LongType())(text)
