"""Language ID by a bit-sliced Bloom filter of n-grams.

Each slot of the filter holds a bit for every language. An n-gram's languages are the bits that all its slots share,
so one lookup asks for all languages at once. A text's n-grams are counted for each language, what the filter's false
positives add is taken off, and the language with most decides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, crc_mod, only, slices, table

SIZES = (3, 4, 5)  # letters of an n-gram, a word's edge counting as one
SLOTS_LOG2 = 21  # slots of the filter: 2**21 longs for up to 64 languages, 16 MB whatever the corpus
PROBES = 2
GRAM_BYTES = 1 << 18  # of texts whose n-grams a worker holds at once: about 300 bytes of arrays for each
#: Documents of a language that training reads at most, about: the bound of the training sample, a parameter.
SAMPLE_A_LANGUAGE = 4000
#: Languages that are learned at most: four slices of the filter.
MOST_LANGUAGES = 256
#: An n-gram belongs to a language if it is at least so frequent there, against where it is most frequent ...
LEAST_SHARE = 0.2
#: ... and was seen so often there.
LEAST_SEEN = 3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> code point of the lower-case letter, 0 for what isn't a letter."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(0x41, 0x40000):  # no letters are assigned beyond
        c = chr(code)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, and how many each text has. A text with a letter has at least one."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    with np.errstate(over="ignore"):
        for i, text in enumerate(texts):
            if not text:
                continue
            c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
            c = np.concatenate([[0], c, [0]]).astype(np.uint64)
            c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
            h = c.copy()
            for n in range(2, SIZES[-1] + 1):
                if len(c) < n:
                    break
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
                if n in SIZES:
                    # an edge may only be at either end: inside, another word would begin
                    inner = (c[1 : len(c) - n + 2] != 0) if n == 3 else np.logical_and.reduce([c[k : len(c) - n + 1 + k] != 0 for k in range(1, n - 1)])
                    found = h[inner[: len(h)]] ^ np.uint64(n)
                    hashes.append(found)
                    counts[i] += len(found)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    """The filter's slots of each hash."""
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    return [((mixed >> np.uint64(p * SLOTS_LOG2)) & np.uint64((1 << SLOTS_LOG2) - 1)).astype(np.int64) for p in range(PROBES)]


@dataclass
class Model:
    """Languages by name, and slices of 64 languages: each a long for every slot."""

    languages: list[str]
    slices: list[np.ndarray]
    positives: list[float] = field(default_factory=list)  # false-positive rate of each language

    def __post_init__(self) -> None:
        self.positives = [float(np.mean((s := self.slices[k // 64]) >> np.uint64(k % 64) & np.uint64(1)) ** PROBES) for k in range(len(self.languages))]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Of each text the language, its share of what all languages know of it, and the share of n-grams it knows."""
        hashes, counts = grams(texts)
        at = np.flatnonzero(counts)
        found, scores, known = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not len(at) or not self.languages:
            return found, scores, known
        begins = np.concatenate([[0], np.cumsum(counts[at])[:-1]])
        n, by = counts[at].astype(float), np.zeros((len(self.languages), len(at)))
        where = slots(hashes)
        for s, bits in enumerate(self.slices):
            held = np.bitwise_and.reduce([bits[w] for w in where])
            for k in range(64 * s, min(64 * s + 64, len(self.languages))):
                hits = np.add.reduceat((held >> np.uint64(k % 64) & np.uint64(1)).astype(np.int64), begins)
                fp = self.positives[k]
                by[k] = np.clip((hits - n * fp) / max(1e-9, 1 - fp), 0, None)
        best, total = by.argmax(axis=0), by.sum(axis=0)
        most = by.max(axis=0)
        for i, k, share, of_all in zip(at.tolist(), best.tolist(), (most / np.where(total > 0, total, 1)).tolist(), (most / n).tolist(), strict=True):
            found[i], scores[i], known[i] = self.languages[k], min(1.0, share), min(1.0, of_all)
        return found, scores, known


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE_A_LANGUAGE, most: int = MOST_LANGUAGES) -> Model:
    """A model of rows with a language; rows without text or language don't count.

    Of a language with more than `sample` documents, a share by the hash of the id is read, so that about `sample` are. Of
    more than `most` labels those with the most documents are learned, then the first by name: where labels are dirty,
    their number, and so the model's size, stays bounded. The filter is summed up by slot on the executors; it has
    2**SLOTS_LOG2 longs for 64 languages, however large the corpus, and that much reaches the driver.
    """
    rows = only(labelled, id_col, text_col, lang_col).toDF("_id", "_text", "_lang").filter("_text is not null and _lang is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(most).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], [])
    shares = F.broadcast(rows.sparkSession.createDataFrame([(k, i, min(1.0, sample / sizes[k])) for i, k in enumerate(languages)], "_lang string, k int, share double"))  # `most` rows
    draw = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    kept = rows.join(shares, "_lang").filter(draw < F.col("share")).select("k", F.col("_text").alias("body"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, GRAM_BYTES):  # the aggregate that follows combines the parts before it shuffles
            ks = np.array(batch.column(0).to_pylist())
            texts = batch.column(1).to_pylist()
            for k in np.unique(ks):
                hashes, _ = grams([texts[i] for i in np.flatnonzero(ks == k)])
                seen, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k, np.int32)), pa.array(seen.view(np.int64)), pa.array(n.astype(np.int64))], names=["k", "gram", "n"])

    seen = checkpointed(kept.mapInArrow(count, "k int, gram bigint, n bigint").groupBy("k", "gram").agg(F.sum("n").alias("n")))
    totals = {r[0]: r[1] for r in seen.groupBy("k").agg(F.sum("n")).collect()}
    all_of = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(float(n)))]) if totals else None
    if all_of is None:
        return Model(languages, [np.zeros(1 << SLOTS_LOG2, np.uint64) for _ in range(-(-len(languages) // 64))])
    rated = seen.select("gram", "k", "n", (F.col("n") / all_of[F.col("k")]).alias("rate"))
    most = rated.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("k", "n", "rate")).alias("each"))  # at most as many as languages
    held = most.select("gram", F.explode(F.filter("each", lambda x: (x["rate"] >= F.col("most") * LEAST_SHARE) & (x["n"] >= LEAST_SEEN))).alias("x")).select("gram", "x.k")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            bit = (np.uint64(1) << (k % 64).astype(np.uint64)).view(np.int64)
            for where in slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array((k // 64).astype(np.int32)), pa.array(where), pa.array(bit)], names=["slice", "slot", "bits"])

    filled = held.mapInArrow(place, "slice int, slot bigint, bits bigint").groupBy("slice", "slot").agg(F.bit_or("bits").alias("bits"))
    held_bits = [np.zeros(1 << SLOTS_LOG2, np.uint64) for _ in range(-(-len(languages) // 64))]
    got = filled.toArrow()
    for s in range(len(held_bits)):
        mine = np.asarray(got.column("slice")) == s
        held_bits[s][np.asarray(got.column("slot"))[mine]] = np.asarray(got.column("bits"))[mine].view(np.uint64)
    return Model(languages, held_bits)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (the language's share of what all languages know of the text) and known (the share of the
    text's n-grams that it knows).

    Null texts and texts without a letter are `und` with score and known 0; a text whose n-grams no language has is given
    to the first language with 0 and 0. Ties go to the first language by name; repeated rows get the same; an empty table
    gives an empty one. Input columns of these names are replaced; texts of any length are read whole, a
    few at once; the model is broadcast, its size is fixed. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, GRAM_BYTES):
            names, scores, known = held.value.predict(part.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.float64())], names=[*part.schema.names, "lang_pred", "score", "known"])

    rows = docs.drop("lang_pred", "score", "known")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "lang_pred string, score double, known double"])
    return rows.mapInArrow(run, schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = train(docs.filter(~out))
    return identify(only(docs, "doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
