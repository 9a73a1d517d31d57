"""Toxicity by weak supervision.

Many voters look at a text: lexicons, patterns, and words or word beginnings that stand out in labelled documents. Each
votes or abstains. A generative label model estimates how often each voter votes on toxic and on other documents, and
how much voters repeat each other within a class; the given labels are one more, fallible voter. Its posteriors, not the
labels, train a linear classifier on word features, which scores every document.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, only, slices, table

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6)
#: Seed lexicons, a voter each.
LEXICONS = {
    "insults_en": "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown jerk fool imbecile lowlife".split(),
    "insults_de": "idiot dumm trottel arschloch abschaum versager widerlich wertlos erbärmlich schwachkopf".split(),
    "insults_fr": "idiot imbécile crétin connard salaud ordure minable dégoûtant abruti".split(),
    "insults_es": "idiota imbécil estúpido basura escoria patético asqueroso inútil payaso".split(),
    "threats": "kill die hurt destroy punch".split(),
}
#: Pattern voters.
PATTERNS = {
    "shouting": re.compile(r"(?:\b[A-Z]{4,}\b[ ,]+){3}"),
    "exclaiming": re.compile(r"[!?]{3,}"),
    "masked": re.compile(r"\b[a-zA-Z]{1,3}[*@#$%]{2,}[a-zA-Z]+\b"),
    "addressed": re.compile(r"\byou(?:'re| are) (?:a|an|such|so)\b", re.I),
}
#: Correlations within a class below this are taken for chance.
LEAST_CORRELATION = 0.1
#: What a voter's silence counts, against its speaking.
ABSTENTION = 0.5


@dataclass(frozen=True)
class Settings:
    sample: int = 30_000  # labelled rows that training reads at most, about: the bound of the training sample
    features: int = 400  # words and beginnings that the classifier knows
    voters: int = 48  # of these, how many vote themselves
    least_seen: int = 4  # toxic documents with a feature
    least_lift: float = 2.0  # logarithm of how much likelier a feature is in toxic documents
    rounds: int = 40  # of expectation and maximisation
    ridge: float = 1.0


def features(text: str | None) -> dict[str, int]:
    """Words ("w:") and beginnings of longer words ("b:") of a text with how often they occur."""
    out: dict[str, int] = defaultdict(int)
    for w in WORD.findall((text or "").lower()):
        out["w:" + w] += 1
    for key, n in list(out.items()):
        for k in PREFIXES:
            if len(key) > k + 2:
                out["b:" + key[2 : k + 2]] += n
    return out


def patterns(text: str | None, words: dict[str, int]) -> list[int]:
    """Votes of the lexicons and patterns."""
    return [int(any("w:" + w in words for w in lexicon)) for lexicon in LEXICONS.values()] + [int(bool(text and p.search(text))) for p in PATTERNS.values()]


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Posterior that each row is toxic, from votes (1, or 0 for abstaining) and 0/1 labels, which are a voter too.

    Voters are taken as independent within a class but for repetition: a voter that goes along with others inside a
    class, by their correlations there, has its log-likelihood ratio divided by the number it stands for. Abstaining
    counts ABSTENTION of what it would if every voter knew every language.
    """
    x, given = votes.astype(float), labels > 0
    p = np.where(given, 0.9, 0.05)  # labels are believed at first, not for good
    for _ in range(rounds):
        weights = np.stack([1 - p, p])
        size = weights.sum(axis=1)
        rate, given_rate = (weights @ x + 0.05) / (size[:, None] + 0.1), (weights @ given + 0.05) / (size + 0.1)
        together = np.zeros((x.shape[1], x.shape[1]))
        for c in range(2):
            centred = x - rate[c]
            covariance = (centred.T * weights[c]) @ centred / size[c]
            spread = np.sqrt(np.maximum(1e-9, np.diag(covariance)))
            together += size[c] / len(x) * (covariance / np.outer(spread, spread)).clip(0, 1)
        stands_for = np.where(together > LEAST_CORRELATION, together, 0).sum(axis=0).clip(1)  # itself counts 1
        spoke, silent = np.log(rate[1] / rate[0]) / stands_for, np.log((1 - rate[1]) / (1 - rate[0])) / stands_for
        label = np.where(given, np.log(given_rate[1] / given_rate[0]), np.log((1 - given_rate[1]) / (1 - given_rate[0])))
        prior = np.clip(p.mean(), 1e-4, 1 - 1e-4)
        total = x @ spoke + ABSTENTION * ((1 - x) @ silent) + label + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        if np.abs(new - p).max() < 1e-6:
            return new
        p = new
    return p


def logistic(x: np.ndarray, p: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Weights, the last one the constant, of the ridge regression of probabilities p, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * np.maximum(q * (1 - q), 1e-6)) @ x + np.diag(penalty), x.T @ (q - p) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    names: dict[str, int]  # feature -> column
    weights: np.ndarray

    def row(self, text: str | None) -> tuple[dict[int, int], list[int]]:
        words = features(text)
        return {k: words[name] for name, k in self.names.items() if name in words}, patterns(text, words)

    def dense(self, rows: list[tuple[dict[int, int], list[int]]]) -> np.ndarray:
        """Presence of each feature, votes of patterns, and how many feature words there are, in logarithms."""
        n = len(self.names)
        out = np.zeros((len(rows), n + len(LEXICONS) + len(PATTERNS) + 1))
        for i, (found, votes) in enumerate(rows):
            out[i, list(found)] = 1
            out[i, n:-1] = votes
            out[i, -1] = np.log1p(sum(found.values()))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.dense([self.row(t) for t in texts]) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of documents with labels 0 or 1; other labels and null ids don't count.

    Of more than settings.sample labelled rows a share by the hash of the id is read, about so many. Features are
    counted on the executors; the best few and the sample's feature rows reach the driver. Without labelled documents,
    or of one class alone, every text gets the share of toxic labels, 0 without any.
    """
    known = only(labels, id_col, label_col).filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    n, toxic = known.select(F.count("*"), F.sum("_y")).first()
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, settings.sample / max(1, n)))
    # the drawn labels are about settings.sample narrow rows, so they go to the texts, and no text is shuffled
    rows = only(docs, id_col, text_col).filter(draw).join(F.broadcast(known.filter(draw)), id_col).select(F.col(text_col).alias("body"), "_y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0, 1 << 21):
            seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for f in features(text):
                    seen[f][y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["feature", "other", "toxic"])

    base = np.clip((toxic or 0) / max(1, n), 1e-4, 1 - 1e-4)
    flat = Model({}, np.array([0.0] * (len(LEXICONS) + len(PATTERNS) + 1) + [float(np.log(base / (1 - base)))]))
    if not n or not toxic or toxic == n:
        return flat
    counted = rows.mapInArrow(count, "feature string, other bigint, toxic bigint").groupBy("feature").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    lift = F.log((F.col("toxic") + 0.5) / F.lit(float(base))) - F.log((F.col("other") + 0.5) / F.lit(float(1 - base)))
    # a lift counts by how sure it is: the more toxic documents have the feature, the better
    best = counted.filter((F.col("toxic") >= settings.least_seen) & (lift > settings.least_lift)).select("feature", (lift * F.sqrt(F.col("toxic").cast("double"))).alias("worth")).orderBy(F.desc("worth"), "feature").limit(settings.features)
    names = [r[0] for r in best.collect()]
    model = Model({f: k for k, f in enumerate(names)}, flat.weights)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            made = [model.row(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([list(f) for f, _ in made], pa.list_(pa.int32())), pa.array([list(f.values()) for f, _ in made], pa.list_(pa.int32())), pa.array([v for _, v in made], pa.list_(pa.int32())), batch.column(1)], names=["at", "n", "votes", "y"])

    sample = rows.mapInArrow(look, "at array<int>, n array<int>, votes array<int>, y int").toArrow()
    made = [(dict(zip(a, c, strict=True)), v) for a, c, v in zip(*(sample.column(k).to_pylist() for k in range(3)), strict=True)]
    if not made:
        return flat
    x, y = model.dense(made), np.array(sample.column(3).to_pylist())
    own = min(settings.voters, len(names))
    votes = np.column_stack([x[:, :own], x[:, len(names) : -1]])
    model.weights = logistic(x, label_model(votes, y, settings.rounds), settings.ridge)
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5, else 0), of whole texts and of nothing else.

    Null and empty texts have the score of a text without any feature; repeated rows get the same; an empty table gives an
    empty one. Input columns of these names are replaced. The
    model, of a fixed size, is broadcast; no shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held.value.score(part.column(text_col).to_pylist()), pa.float64())], names=[*part.schema.names, "score"])

    rows = docs.drop("score", "predicted")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "score double"])
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    model = train(docs.filter(~out), table(spark, sf_dir, "labels").filter(~out))
    return scored(only(docs, "doc_id", "text"), model).select("doc_id", out.alias("held_out"), "score", "predicted")
