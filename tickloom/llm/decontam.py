"""Benchmark decontamination by a BM25 index of test items and block-max WAND.

Items are cut into segments of a few dozen words and weighted by BM25; an item's weight of a word is the sum over its
segments. Inverted: word -> items, and word -> blocks of items with the largest weight in each. Every whole document is
a query, as a leak may be scattered over it. Upper bounds from the blocks skip whole blocks of items; what remains is
scored exactly, and all items above their threshold are retrieved. Hashes of shingles leave out those that share words
only. Then the words themselves are compared: how many of the item's word shingles, question and answer, the document has.

Thresholds are lossless: an item's is its score against itself less the largest weights of so many of its words as may be
missing from a document that still has the wanted share of its shingles, wherever they stand.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, slices, table

#: Scripts that are written without spaces: Thai, Lao, Burmese, Khmer, kana, bopomofo, ideographs.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: A word: a character of those scripts, or a run of other letters and digits.
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
#: Where an item's last sentence, taken for its answer, may begin.
SENTENCE = re.compile(r"[.!?]+\s+|\n+")


@dataclass(frozen=True)
class Settings:
    shingle: int = 5  # words
    overlap: float = 0.8  # share of an item's shingles that makes a leak
    segment: int = 64  # words of a segment, at most
    block: int = 8  # items of a block
    k1: float = 1.2
    b: float = 0.75
    index_mb: int = 16  # of item texts in one index; more items make more passes


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(ws: list[str], k: int) -> set[tuple[str, ...]]:
    """Word shingles; of fewer words, the whole sequence."""
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of so many places from each start, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Index:
    """The inverted index of some items: (item_id, text) pairs. Its size is bounded by Settings.index_mb."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings = Settings()):
        self.settings, self.items, segments, lengths = settings, [], [], []
        for item_id, text in items:
            if not (ws := words(text)):
                continue
            cut = [m.end() for m in SENTENCE.finditer(text.rstrip())]
            n_answer = len(words(text[cut[-1] :])) if cut else 0
            every, k = shingles(ws, settings.shingle), settings.shingle
            answer = shingles(ws[len(ws) - n_answer :], k) & every if 0 < n_answer < len(ws) else set()
            self.items.append((item_id, every - answer, answer))
            lengths.append(len(ws))
            n = -(-len(ws) // settings.segment)
            segments += [(len(self.items) - 1, ws[i * len(ws) // n : (i + 1) * len(ws) // n]) for i in range(n)]
        self.n_blocks = -(-len(self.items) // settings.block)
        counts = [Counter(ws) for _, ws in segments]
        df = Counter(w for c in counts for w in c)
        self.vocabulary = {w: t for t, w in enumerate(df)}
        mean = sum(len(ws) for _, ws in segments) / max(1, len(segments))
        weights: list[dict[str, float]] = [{} for _ in self.items]
        for (i, ws), c in zip(segments, counts, strict=True):
            norm = settings.k1 * (1 - settings.b + settings.b * len(ws) / mean)
            for w, n in c.items():
                x = np.log1p((len(segments) - df[w] + 0.5) / (df[w] + 0.5)) * n * (settings.k1 + 1) / (n + norm)
                weights[i][w] = weights[i].get(w, 0.0) + x
        rows: list[tuple[int, int, float]] = []
        for i, weight in enumerate(weights):
            rows += [(self.vocabulary[w], i, x / self._threshold(i, lengths[i], weight)) for w, x in weight.items()]
        rows.sort()
        self.term, self.item = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        self.weight = np.array([r[2] for r in rows])
        self.at = np.searchsorted(self.term, np.arange(len(df) + 1))
        key = self.term * max(1, self.n_blocks) + self.item // settings.block
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        self.block = key[starts] % max(1, self.n_blocks)
        self.block_most = np.maximum.reduceat(self.weight, starts) if len(starts) else np.zeros(0)
        self.block_at = np.searchsorted(self.term[starts], np.arange(len(df) + 1))
        self.block_from, self.block_n = starts, np.diff(starts, append=len(key))
        hashes = [self._hashes(np.array([[self.vocabulary[w] for w in s] for s in q | a if len(s) == settings.shingle], np.int64).reshape(-1, settings.shingle)) for _, q, a in self.items]
        self.hash, self.hash_n = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.array([len(h) for h in hashes], np.int64)
        self.hash_from = np.cumsum(self.hash_n) - self.hash_n

    def _threshold(self, i: int, n_words: int, weight: dict[str, float]) -> float:
        """The least score of a document that holds item i.

        Of n - k + 1 shingles, all different, m missing words leave out m at least. Where shingles repeat, each missing
        word that begins a shingle leaves out one of its own; only words of the last k - 1 places may begin none.
        """
        _, question, answer = self.items[i]
        n, k = len(question) + len(answer), self.settings.shingle
        may_miss = int(n * (1 - self.settings.overlap) + 1e-9)
        if may_miss and n < n_words - k + 1:
            may_miss += k - 1
        return max(1e-9, sum(sorted(weight.values())[: max(1, len(weight) - may_miss)]))

    @staticmethod
    def _hashes(ids: np.ndarray) -> np.ndarray:
        """A hash of each row of word ids."""
        out = np.zeros(len(ids), np.uint64)
        for column in ids.T:
            out = (out + column.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def retrieve(self, docs: list[list[str]]) -> list[tuple[int, int, float]]:
        """(document, item, score against the threshold, 1 or more) of every document and item above it."""
        if not self.items:
            return []
        v, k, get = len(self.vocabulary), self.settings.shingle, self.vocabulary.get
        ids = [np.array(list(map(get, ws, repeat(-1))), np.int64) for ws in docs]
        flat, owner = np.concatenate([*ids, np.zeros(0, np.int64)]), np.repeat(np.arange(len(docs)), [len(x) for x in ids])
        pairs = np.unique(owner[flat >= 0] * v + flat[flat >= 0])
        doc, tid = pairs // v, pairs % v
        # upper bounds of each document in each block
        n = self.block_at[tid + 1] - self.block_at[tid]
        at, doc = _ragged(self.block_at[tid], n), np.repeat(doc, n)
        _, place = np.unique(doc * self.n_blocks + self.block[at], return_inverse=True)  # of blocks that share a word with it
        # postings in likely blocks alone
        kept = np.bincount(place, self.block_most[at])[place] >= 1 - 1e-9 if len(place) else np.zeros(0, bool)
        at, doc = at[kept], doc[kept]
        n = self.block_n[at]
        at, doc = _ragged(self.block_from[at], n), np.repeat(doc, n)
        keys, place = np.unique(doc * len(self.items) + self.item[at], return_inverse=True)
        scores = np.bincount(place, self.weight[at], len(keys))
        keys, scores = keys[scores >= 1 - 1e-9], scores[scores >= 1 - 1e-9]
        doc, item = keys // len(self.items), keys % len(self.items)
        # as many of an item's shingles, by hash, as a leak has; items of fewer words than a shingle have none and stay
        found: list[tuple[int, int, float]] = []
        for d in np.unique(doc).tolist():
            mine = slice(*np.searchsorted(doc, [d, d + 1]).tolist())
            rows = np.lib.stride_tricks.sliding_window_view(ids[d], k) if len(ids[d]) >= k else np.zeros((0, k), np.int64)
            held = np.unique(self._hashes(rows[(rows >= 0).all(axis=1)]))
            n = self.hash_n[item[mine]]
            asked = self.hash[_ragged(self.hash_from[item[mine]], n)]
            here = np.isin(asked, held)
            common = np.bincount(np.repeat(np.arange(len(n)), n), here, len(n))
            enough = common >= self.settings.overlap * n - 1e-9
            found += [(d, i, s) for i, s in zip(item[mine][enough].tolist(), scores[mine][enough].tolist(), strict=True)]
        return found

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        """Of each text, the items that it holds by the wanted share of their shingles."""
        docs = [words(t) for t in texts]
        out: list[list[dict]] = [[] for _ in docs]
        held: dict[int, set] = {}
        for d, i, score in self.retrieve(docs):
            item_id, question, answer = self.items[i]
            lengths = {len(s) for s in question | answer}
            if d not in held:
                held = {d: set()}
                held[d] = shingles(docs[d], self.settings.shingle)
            short = {tuple(docs[d][j : j + k]) for k in lengths if k < self.settings.shingle for j in range(len(docs[d]) - k + 1)}
            mine = held[d] | short if short else held[d]
            q, a = len(question & mine), len(answer & mine)
            if (q + a) >= self.settings.overlap * (len(question) + len(answer)):
                out[d].append({"item_id": item_id, "score": score, "question_overlap": q / len(question) if question else None, "answer_overlap": a / len(answer) if answer else None, "overlap": (q + a) / (len(question) + len(answer))})
        return out


LEAKS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,overlap:double>>"


def screened(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with `leaks`: the items that a whole text holds, each with its scores; empty if none.

    Null and empty texts hold nothing; null and wordless items are nothing to hold; an item of fewer words than a shingle
    is looked for as a whole; scripts without spaces are cut into characters, so that an item is found inside a longer run
    of them; items with equal texts are all listed; repeated rows have the same leaks. An input column
    called `leaks` is replaced. Documents stay where they are: no shuffle. Whole texts are read however long they are; a worker
    then holds the words of one.

    The items' total size is measured first: each index takes settings.index_mb of item texts at most, about, and a
    larger benchmark makes more passes. An index is read by the driver and broadcast.
    """
    spark = docs.sparkSession
    bench = only(items, item_id, item_text).filter(F.col(item_text).isNotNull())
    size = bench.select(F.sum(F.octet_length(item_text))).first()[0] or 0
    passes = max(1, -(-size // (settings.index_mb << 20)))
    rows = docs.drop("leaks").withColumn("leaks", F.array().cast(LEAKS))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), *((n, pa.float64()) for n in ("score", "question_overlap", "answer_overlap", "overlap"))]))
    for p in range(passes):
        mine = bench.filter(F.pmod(F.xxhash64(item_id), F.lit(passes)) == p) if passes > 1 else bench
        held = spark.sparkContext.broadcast(Index(sorted((r[0], r[1]) for r in mine.collect()), settings))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text_col):
                found = [[*old, *new] for old, new in zip(part.column("leaks").to_pylist(), held.value.leaks(part.column(text_col).to_pylist()), strict=True)]
                columns = [*part.columns]
                columns[part.schema.get_field_index("leaks")] = pa.array(found, kind)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

        rows = rows.mapInArrow(run, rows.schema)
    return rows


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """A row for each document and item that it holds."""
    rows = screened(only(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
