"""Token ids in binary shards with a shared Zstandard dictionary.

File format of a shard (little-endian): magic ``LWTOK2\\0\\0``; 32 bytes SHA-256
of the dictionary; then one Zstandard frame for each document, holding its ids
as unsigned 16- or 32-bit integers; then the index, one record of
``<q doc_id, ? null, Q start, I n_tokens, Q offset, I length>`` a document; then a
footer ``<Q index offset, Q documents, Q tokens, I id width>`` and the magic again.
``start`` counts the ids before the document within the shard; the manifest has
each shard's ids before it.  One document is read with the index, one seek and
one frame.  Documents with a null doc_id come first.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.kept import kept
from loomwork.llm.zdict import build_dictionary, load_dictionary
from loomwork.workspace import Workspace

MAGIC = b"LWTOK2\0\0"
INDEX = struct.Struct("<q?QIQI")
FOOTER = struct.Struct("<QQQI8s")
#: Bytes of text pieces and words whose ids a worker keeps at hand, about.
_MEMO_BYTES = 160 << 20
_ENTRY = 200
#: Longer pieces are not kept.
_LONG = 64

#: Encodes texts as little-endian ids; built on the worker from the tokenizer file's bytes.
Encoder = Callable[[list[str]], list[bytes]]

# The normalizer and the split of the tokenizer file whose texts can be cut into words.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same split of lower-cased text of plain characters: printable ASCII and the
#: letters up to U+00FF, which are composed and have one lower-case character each.
#: A line's end stands between pieces, which hold none.
_SPLIT_PLAIN = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+")
_PLAIN = re.compile("[!-;=-~À-ÖØ-öø-ÿ]+")  # without <, which begins added tokens
_ALL_PLAIN = re.compile("[\n!-;=-~À-ÖØ-öø-ÿ]+")


class WordEncoder:
    """Encodes with the tokenizers library, every distinct word once.

    A tokenizer file that drops white space, lower-cases and splits words as
    ``_SPLIT`` does lets texts be cut there: no token crosses it, so a text's ids are
    those of its pieces one after another.  A piece of plain characters is cut into
    words by the same rule, and the library's model is asked for each word; any other
    piece goes to the library whole, and so does every text if the file is of another
    form.
    """

    _gap = re.compile(r"[ \t\n\r]+")
    _odd = re.compile("[\x1c-\x1f]")  # white space for str.split, but not for the library

    def __init__(self, file: bytes, width: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        self.library, self.kind = Tokenizer.from_str(file.decode()), f"<u{width}"
        self.library.no_padding()
        self.library.no_truncation()
        self.ask_word = self.library.model.tokenize
        form = json.loads(file)
        steps = (form.get("normalizer") or {}).get("normalizers", [])
        split = ((form.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.cuts = (
            [s.get("type") for s in steps] == _NORMALIZERS
            and split.get("pattern") == {"Regex": _SPLIT}
            and all(t["content"].startswith("<") and not re.search(r"\s", t["content"]) for t in form["added_tokens"])
            and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in form["added_tokens"])
        )
        # how the file writes bytes as characters, from the library itself
        letters = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ" if self.cuts else ""
        self.as_bytes = {ord(c): self.library.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters if not c.isascii()}
        self.code = "H" if width == 2 else "I"
        self.words: dict[str, bytes] = {}
        self.pieces, self.room = {"": b""}, _MEMO_BYTES

    def _whole(self, texts: list[str]) -> list[bytes]:
        got = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(g.ids, self.kind).tobytes() for g in got]

    def _bytes(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Keep the ids of new pieces: the plain ones are cut into words all at once, the others go to the library."""
        joined = "\n".join(pieces)
        if not _ALL_PLAIN.fullmatch(joined):
            odd = [p for p in pieces if not _PLAIN.fullmatch(p)]
            self.pieces.update(zip(odd, self._whole(odd), strict=True))
            self.room -= sum(map(len, odd)) * 3 + _ENTRY * len(odd)
            pieces = [p for p in pieces if _PLAIN.fullmatch(p)]
            joined = "\n".join(pieces)
        if not pieces:
            return
        split, words, ask = _SPLIT_PLAIN.findall(joined.lower()), self.words, self.ask_word
        new = [w for w in set(split) if w not in words]
        for word in new:
            words[word] = self._bytes([t.id for t in ask(word if word.isascii() else word.translate(self.as_bytes))]) if word != "\n" else b""
        coded = list(map(words.__getitem__, split))
        at = 0
        for piece, end in zip(pieces, [*(i for i, w in enumerate(split) if w == "\n"), len(split)], strict=True):
            self.pieces[piece] = coded[at] if end - at == 1 else b"".join(coded[at:end])
            at = end + 1
        self.room -= 3 * (len(joined) + sum(map(len, new))) + _ENTRY * (len(pieces) + len(new))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return [i for at in range(0, len(texts), 64) for i in self._whole(texts[at : at + 64])]
        out = []
        for at in range(0, len(texts), 64):
            split = [self._gap.split(t) if self._odd.search(t) else t.split() for t in texts[at : at + 64]]
            if self.room < 0:
                self.words, self.pieces, self.room = {}, {"": b""}, _MEMO_BYTES
            pieces = self.pieces
            new = [p for p in set().union(*split) if p not in pieces]
            self._learn(new)
            out += [b"".join(map(pieces.__getitem__, own)) for own in split]
            for p in new:
                if len(p) > _LONG:
                    del pieces[p]
        return out


def worker_encoder(file: bytes, width: int) -> WordEncoder:
    """This worker's encoder, kept for its next task."""
    return kept(("words", hashlib.sha256(file).digest(), width), lambda: WordEncoder(file, width))


class ShardWriter:
    """Builds one shard file; documents arrive in order."""

    def __init__(self, dictionary: bytes, width: int, level: int):
        self.sha = hashlib.sha256(dictionary).digest()
        self.zstd = zstandard.ZstdCompressor(level=level, dict_data=load_dictionary(dictionary))
        self.width, self.body, self.index, self.at, self.tokens = width, [MAGIC, self.sha], [], len(MAGIC) + 32, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame, n = self.zstd.compress(ids), len(ids) // self.width
        self.index.append(INDEX.pack(doc_id or 0, doc_id is None, self.tokens, n, self.at, len(frame)))
        self.body.append(frame)
        self.at += len(frame)
        self.tokens += n

    def data(self) -> bytes:
        return b"".join([*self.body, *self.index, FOOTER.pack(self.at, len(self.index), self.tokens, self.width, MAGIC)])


class ShardReader:
    """Random access to one shard's documents."""

    def __init__(self, file: BinaryIO, dictionary: bytes):
        self.file = file
        self.file.seek(0, 2)
        end = self.file.tell()
        self.file.seek(end - FOOTER.size)
        at, self.n, self.tokens, self.width, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.file.seek(0)
        if self.file.read(len(MAGIC) + 32) != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError("a shard was written with another dictionary")
        self.file.seek(at)
        self.index = self.file.read(self.n * INDEX.size)
        self.zstd = zstandard.ZstdDecompressor(dict_data=load_dictionary(dictionary))

    def __getitem__(self, i: int) -> tuple[int | None, int, np.ndarray]:
        """doc_id, start and ids of the i-th document."""
        doc_id, null, start, _, offset, length = INDEX.unpack_from(self.index, i * INDEX.size)
        self.file.seek(offset)
        ids = np.frombuffer(self.zstd.decompress(self.file.read(length)), f"<u{self.width}")
        return None if null else doc_id, start, ids


def write_token_shards(
    docs: DataFrame,
    make_encoder: Callable[[int], Encoder],
    end_id: int,
    max_id: int,
    work: Workspace,
    shard_bytes: int = 8 << 20,
    dictionary_bytes: int = 32 << 10,
    sample_rows: int = 2000,
    sample_bytes: int = 8 << 10,
    level: int = 3,
    most_parts: int = 20_000,
) -> tuple[DataFrame, DataFrame, bytes]:
    """Encode whole texts and write their ids, ascending by doc_id, in token shards.

    Input: doc_id long and text (null: empty).  Output: the shards (name, data, tokens,
    docs), rows of a written table, of which ``files.put_out`` makes files; their places
    (name, base: ids before the shard); and the shared dictionary.  The dictionary
    learns from about ``sample_rows`` rows drawn by a hash of the row, a window of at
    most ``sample_bytes`` of each, at a place drawn likewise: a bounded sample.

    Texts are encoded once; the written ids are dealt by ranges of doc_id, a repeated
    id being split by a number given when they were written, and each range is
    streamed into shards of about ``shard_bytes``.
    """
    spark = docs.sparkSession
    width = 2 if max_id < 1 << 16 else 4
    tail = end_id.to_bytes(width, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder(width)
        for batch in batches:
            ids = [i + tail for i in encoder(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    coded = rows.mapInArrow(encode, "doc_id long, ids binary")
    coded = work.save(coded.select("*", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("u")), "ids")
    n, total = coded.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()
    windows = F.greatest(F.floor((F.length("ids") - sample_bytes) / width) + 1, F.lit(1))
    place = (F.pmod("h", windows) * width + 1).cast("int")
    drawn = coded.where(F.pmod(F.xxhash64("u", "h"), F.lit(max(n, 1))) < sample_rows)
    drawn = drawn.select("doc_id", "u", F.substring("ids", place, F.lit(sample_bytes)).alias("part"))
    sample = [bytes(r.part) for r in sorted(drawn.collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.u))]
    dictionary = build_dictionary(sample, dictionary_bytes, 256)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer, seq = TaskContext.get().partitionId(), None, 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"name": [f"part-{own:07d}-{seq:05d}.ids"], "data": [writer.data()], "part": [own], "seq": [seq], "tokens": [writer.tokens], "docs": [len(writer.index)]})

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                writer = writer or ShardWriter(dictionary, width, level)
                writer.add(doc_id, ids.as_py())
                if writer.tokens * width >= shard_bytes:
                    yield close()
                    writer, seq = None, seq + 1
        if writer:
            yield close()

    parts = min(most_parts, max(1, -(-total // shard_bytes)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("u")]
    dealt = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    manifest = work.save(dealt.mapInArrow(write, "name string, data binary, part long, seq long, tokens long, docs long"), "shards")
    work.drop("ids")
    sums, before, starts = sorted(map(tuple, manifest.groupBy("part").agg(F.sum("tokens")).collect())), 0, []
    for part, tokens in sums:  # a row a range, ``most_parts`` at most
        starts.append((part, before))
        before += tokens
    base = spark.createDataFrame(starts, "part long, start long")
    prior = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    within = manifest.select("name", "part", F.coalesce(F.sum("tokens").over(prior), F.lit(0)).alias("within"))
    bases = within.join(base, "part").select("name", (F.col("start") + F.col("within")).alias("base"))
    return manifest.select("name", "data", "tokens", "docs"), bases, dictionary


def read_token_shards(shards: DataFrame, bases: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards themselves."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["name"].to_pylist(), batch["data"], strict=True):
                shard = ShardReader(io.BytesIO(data.as_py()), dictionary)
                rows = []
                for i in range(shard.n):
                    doc_id, start, ids = shard[i]
                    rows.append((name, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                kinds = (pa.string(), *[pa.int64()] * 4)
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["name", "doc_id", "start", "n_tokens", "ids_crc32"])

    found = shards.select("name", "data").mapInArrow(read, "name string, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(bases, "name").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def word_token_file(docs: DataFrame, tokenizer_file: bytes, end_id: int = 1) -> DataFrame:
    """Encode ``docs`` with a tokenizers file, write the shards and read them back.

    Input: doc_id, text; other columns are ignored.  Output, one row per input row:
    doc_id, start, n_tokens (with the end id), ids_crc32.  A null text is empty:
    only the end id.  A null doc_id comes first; rows that repeat an id follow each
    other, by a hash of their ids.  Strings of the file's added tokens inside a text
    get their ids, as the library gives them.  An empty table gives an empty result.
    """
    from tokenizers import Tokenizer

    if len(tokenizer_file) > 64 << 20:
        raise ValueError("a tokenizer file of over 64 MiB is not sent to the workers")
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_file)
    size = Tokenizer.from_str(tokenizer_file.decode()).get_vocab_size()
    work = Workspace(docs.sparkSession, "tokens")
    return read_token_shards(
        *write_token_shards(docs, lambda width: worker_encoder(shared.value, width), end_id, max(size, end_id), work)
    )
