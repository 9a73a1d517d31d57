"""Byte-level BPE by monoid tree reduction.

A text is halved down to leaves, which are encoded on their own. What is known of a span is a monoid element: the ids
of its core, and the edges of text on both sides that a neighbour can still change. Joining two spans re-encodes the
window between their cores, an edge of each, and keeps both cores.

Why the cores are stable: in the tokenizers' pattern no match has white space after other characters, so where a space
or newline follows a character that isn't white space, a match ends and another begins in every context; merges stay
inside matches. A core lies between two such places. The window grows, by joining, until it holds one on either side.

A window longer than a leaf (a text without white space, a long run of it) is cut into the pattern's matches, and a match
longer than a leaf is reduced by a tree of its own, on tokens: two halves' ids are joined by re-encoding the last tokens of
one with the first of the other, and the window grows until the tokens at its edges are stable. They are where each stays
apart from its neighbour when the two are encoded alone: a row of tokens is the encoding of its bytes exactly if every two
neighbours are that of theirs. So no call of the encoder sees more than a few leaves.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, slices, table

#: Characters of a leaf.
LEAF = 2048
#: A place that no match crosses.
STABLE = re.compile(r"(?<=\S)(?=[ \n])")


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(tokenizer(path, pattern), pattern)


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    """The merges of a rank file, once for each worker process. They are trained elsewhere and only read here."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class Span:
    """head + the text of ids + tail, where ids can't change any more; ids is None where no stable place is known."""

    head: str
    ids: list[int] | None = None
    tail: str = ""


def _last_stable(text: str) -> int:
    """The last stable place, 0 if there is none."""
    end = len(text)
    while (at := max(text.rfind(" ", 0, end), text.rfind("\n", 0, end))) > 0:
        if not text[at - 1].isspace():
            return at
        end = at
    return 0


def leaf(text: str, encode) -> Span:
    first = STABLE.search(text)
    if first is None:
        return Span(text)
    last = _last_stable(text)
    return Span(text[: first.start()], encode(text[first.start() : last]), text[last:])


def join(a: Span, b: Span, encode) -> Span:
    """The element of two neighbouring spans; the operation is associative in what it yields at the end."""
    if a.ids is None and b.ids is None:
        return Span(a.head + b.head)
    if a.ids is None:
        return Span(a.head + b.head, b.ids, b.tail)
    if b.ids is None:
        return Span(a.head, a.ids, a.tail + b.head)
    return Span(a.head, a.ids + encode(a.tail + b.head) + b.ids, b.tail)


def reduced(text: str, start: int, end: int, encode, size: int = LEAF) -> Span:
    if end - start <= size:
        return leaf(text[start:end], encode)
    mid = (start + end) // 2
    return join(reduced(text, start, mid, encode, size), reduced(text, mid, end, encode, size), encode)


def encode_text(text: str, encode, size: int = LEAF) -> list[int]:
    whole = reduced(text, 0, len(text), encode, size)
    return encode(whole.head) + whole.ids + encode(whole.tail) if whole.ids is not None else encode(whole.head)


class Coder:
    """The encoder of a window of any length: the library's up to a leaf, a reduction of its matches beyond."""

    def __init__(self, library: tiktoken.Encoding, pattern: str, size: int = LEAF):
        self.library, self.matches, self.size = library, regex.compile(pattern), size
        self.apart = lru_cache(maxsize=1 << 16)(self._apart)

    def __call__(self, window: str) -> list[int]:
        if len(window) <= self.size:
            return self.library.encode_ordinary(window)
        out: list[int] = []
        for m in self.matches.finditer(window):
            out += self.match(m[0].encode())
        return out

    def alone(self, data: bytes) -> list[int]:
        """The merges of bytes of one match."""
        return self.library._encode_single_piece(data)

    def match(self, data: bytes) -> list[int]:
        if len(data) <= self.size:
            return self.alone(data)
        mid = len(data) // 2
        return self.joined(self.match(data[:mid]), self.match(data[mid:]))

    def _apart(self, a: int, b: int) -> bool:
        return self.alone(self.library.decode_bytes([a, b])) == [a, b]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring parts of a match."""
        at, ahead = 0, 4
        while at < len(right) and not self.apart(left[-1], right[at]):
            taken, back = right[at : at + ahead], 1
            while True:
                start = max(0, len(left) - back)
                again = self.alone(self.library.decode_bytes(left[start:] + taken))
                if not start or self.apart(left[start - 1], again[0]):
                    break
                back *= 2
            left[start:] = again
            at, ahead = at + len(taken), min(2 * ahead, self.size // 8 or 1)
        return left + right[at:]


def decode_ids(ids: list[int], decode, size: int = LEAF) -> bytes:
    """Bytes are concatenated up the same kind of tree."""
    if len(ids) <= size:
        return decode(ids)
    mid = len(ids) // 2
    return decode_ids(ids[:mid], decode, size) + decode_ids(ids[mid:], decode, size)


def _mapped(rows: DataFrame, column: str, made: list[str], each) -> DataFrame:
    """rows with more binary columns, made from one in Arrow batches that are handed on in parts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            out = list(zip(*(each(v.as_py()) for v in part.column(column)), strict=True))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.binary()) for x in out)], names=[*part.schema.names, *made])

    held = rows.drop(*made)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields), *(f"`{m}` binary" for m in made)])
    return held.mapInArrow(run, schema)


def _ids(text: str | None, path: str, pattern: str) -> bytes:
    return np.array(encode_text(text or "", coder(path, pattern)), "<u4").tobytes()


def _bytes(ids: bytes | None, path: str, pattern: str) -> bytes:
    return decode_ids(np.frombuffer(ids or b"", "<u4").tolist(), tokenizer(path, pattern).decode_bytes)


def encoded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col: the ids of each whole text, as binary of little-endian unsigned 32-bit integers.

    Null and empty texts have no ids; repeated rows stay; an empty table gives an empty one. A text is encoded where it
    lies, without a shuffle; the size of a text bounds what a task holds. The rank file must be at the same path on every machine. An input column called ids_col is replaced.
    """
    return _mapped(docs, text_col, [ids_col], lambda text: (_ids(text, path, pattern),))


def decoded(rows: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """rows with bytes_col: the bytes of the ids; null ids count as none; repeated rows stay; an empty table gives an
    empty one. An input column of that name is replaced."""
    return _mapped(rows, ids_col, [bytes_col], lambda ids: (_bytes(ids, path, pattern),))


def coded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """decoded(encoded(docs)) in one pass, by one Python worker a task."""

    def each(text: str | None) -> tuple[bytes, bytes]:
        ids = _ids(text, path, pattern)
        return ids, _bytes(ids, path, pattern)

    return _mapped(docs, text_col, [ids_col, bytes_col], each)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return coded(only(table(spark, sf_dir, "documents"), "doc_id", "text"), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
