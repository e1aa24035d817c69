"""Best-two-fit packing of tokenised documents into fixed-length sequences.

A sequence is filled greedily with the longest pieces that still fit; then its shortest piece gives way
to the two unpacked pieces that together fill the widened gap more tightly, if there are such.

Pieces are packed in groups of about GROUP pieces each, so that no task holds more than one group,
whatever the input's size; a group wastes less than one sequence.

Defined results: a null text is empty and has the end id alone; repeated ids are separate documents;
further columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, read, settle

LENGTH = 4096
END_ID = 1
GROUP = 8192
#: Words, and pieces between white space, whose ids a worker remembers; beyond that it forgets all and starts again.
REMEMBERED = 400_000
# The tokenizer's own split (fixed value: its pattern), and the same for lower-case Latin-1 text.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
# The byte-level step spells printable bytes as themselves and the others by the characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
_UNSURE = ("\x1c", "\x1d", "\x1e", "\x1f")  # white space to Python only


class WordTokenizer:
    """Ids of whole texts by the tokenizer file, word by word: each distinct word is encoded once.

    Latin-1 texts are taken apart at white space first, and the ids of those pieces are remembered too.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.special = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _of_words(self, words: list[str]) -> None:
        """Learns the words that are new; all of them are known afterwards."""
        new = {w for w in words if w not in self.words}
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
            new = set(words)
        for word in new:
            spelled = "".join([_BYTE_CHARS[b] for b in word.encode()])
            self.words[word] = array("I", [t.id for t in self.inner.model.tokenize(spelled)]).tobytes()

    def _latin(self, text: str) -> bytes:
        parts = text.lower().split()
        found = list(map(self.pieces.get, parts))
        if None in found:
            new = {p: _LATIN.findall(p) for p, ids in zip(parts, found) if ids is None}
            self._of_words([w for ws in new.values() for w in ws])
            words = self.words
            for p, ws in new.items():
                new[p] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
            if len(self.pieces) + len(new) > REMEMBERED:
                self.pieces.clear()
            self.pieces.update(new)
            found = [new[p] if ids is None else ids for p, ids in zip(parts, found)]
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if ("<|" in text and any(s in text for s in self.special)) or any(c in text for c in _UNSURE):
            return np.array(self.inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            words = _SPLIT.findall(self.inner.normalizer.normalize_str(text))
            self._of_words(words)
            return b"".join([self.words[w] for w in words])
        return self._latin(text)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """The worker's own tokenizer, which keeps what it has learnt for the next task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    order = np.argsort(lengths, kind="stable")
    by_length = np.searchsorted(lengths[order], np.arange(capacity + 2))
    left = np.diff(by_length)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    taken = by_length[:-1].copy()
    packed, number = 0, 0

    def longest(limit: int) -> int:
        found = np.flatnonzero(left[: limit + 1])
        return int(found[-1]) if len(found) else -1

    while packed < len(lengths):
        inside, gap = [], capacity
        while gap >= 0 and (size := longest(gap)) >= 0:
            left[size] -= 1
            inside.append(size)
            gap -= size
        if gap and inside:
            room = gap + inside[-1]
            sizes = np.flatnonzero(left[: room + 1])
            if len(sizes):
                at = np.searchsorted(sizes, room - sizes, "right") - 1
                mate = sizes[np.maximum(at, 0)]
                ok = (at >= 0) & ((mate != sizes) | (left[sizes] > 1))
                below = (at > 0) & ~ok  # one piece alone of that length: take the next shorter one
                mate = np.where(below, sizes[np.maximum(at - 1, 0)], mate)
                total = np.where(ok | below, sizes + mate, -1)
                best = int(total.argmax())
                if total[best] > inside[-1]:
                    left[inside.pop()] += 1
                    for size in sorted((int(sizes[best]), int(mate[best])), reverse=True):
                        left[size] -= 1
                        inside.append(size)
        place = 0
        for size in inside:
            row = order[taken[size]]
            taken[size] += 1
            sequence[row], offset[row] = number, place
            place += size
        packed += len(inside)
        number += 1
    return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, *, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids, cut at length only."""
    narrow(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer_of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = own.encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, *, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """pieces() with each piece's sequence_id and offset."""
    cut = settle(pieces(docs, tokenizer, length=length, end_id=end_id))
    groups = max(1, -(-cut.count() // group))
    keyed = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = best_two_fit(table.column("length").to_numpy(), length)
        first = table.column("pack_group")[0].as_py() << 32
        return table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))

    return keyed.groupBy("pack_group").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_two_fit(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), default_tokenizer())
