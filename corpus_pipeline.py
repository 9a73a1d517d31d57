"""The corpus pipeline: five operators, one after the other, over documents.

Every stage works on all that the one before kept. All but the last return the columns of documents; what a stage
decides takes effect there: rows go, or texts change. n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bytebpe, decontam, langid, nearcopies, secrets
from tickloom.llm.common import checkpointed, crc_mod, table
from tickloom.session import settled


#: Share of a text's n-grams that its language must know, or the text has none: clean ones have over a half.
LEAST_KNOWN = 0.2
#: Score from which the model's language replaces another label.
CONFIDENT = 0.7


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns that a stage works on, and `row`, a struct of the others: their names can't clash with what it makes."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, (F.struct(*others) if others else F.lit(0)).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs again, of rows that packed() made; some of them as they are now."""
    own = set(rows.columns)
    return rows.select(*[(changed[c] if c in changed else F.col(c) if c in own and c in ("doc_id", "text") else F.col("row")[c]).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null texts, texts without a letter, and texts of whose n-grams the
    likeliest language knows less than LEAST_KNOWN. `lang` becomes the prediction where it is null or the model contradicts
    it with a score of CONFIDENT or more. Repeated rows are judged alike; where no language can be learned, whatever has a
    letter stays as it is; an empty table gives an empty one; texts of any length are one row. Extra columns stay, whatever
    their names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.train(docs.filter(~out))
    if not model.languages:  # nothing to learn from
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(rows, model).filter((F.col("lang_pred") != "und") & (F.col("known") >= LEAST_KNOWN))
    wrong = F.col("row.lang").isNull() | ((F.col("row.lang") != F.col("lang_pred")) & (F.col("score") >= CONFIDENT))
    lang = F.when(wrong, F.col("lang_pred")).otherwise(F.col("row.lang"))
    return found.select(*[lang.alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least doc_id stays; of rows that repeat it, one. The SimHash index
    finds candidates; texts are linked by a Jaccard similarity of 0.8 or more of their five-word shingles, and groups are
    chains of links.

    Rows are judged one by one, whether or not they have a doc_id or share it: a row goes if its group has a row with a
    lesser doc_id (none being the greatest, then by a hash of the row) or if it is the same row again.
    """
    keyed = nearcopies.hashed(packed(docs, "doc_id", "text"))
    made, parts = nearcopies.groups(keyed)
    # narrow rows decide: which row each group keeps, and how many rows are the same
    keeps = parts.groupBy("label").agg(F.min("row").alias("row")).select("row._h0", "row._h1", F.lit(True).alias("kept"))
    rows = made.groupBy("_h0", "_h1").agg(F.count("*").alias("n")).join(keeps, ["_h0", "_h1"], "left").filter("kept is null or n > 1")
    rows = checkpointed(rows.select("_h0", "_h1", F.col("kept").isNotNull().alias("kept")))
    once = unpacked(keyed.join(rows, ["_h0", "_h1"], "left_anti"), docs)
    repeated = rows.filter("kept")
    if repeated.isEmpty():
        return once
    # rows that are the same: one is taken by an aggregate that combines before it shuffles
    same = keyed.join(repeated, ["_h0", "_h1"], "left_semi").groupBy("_h0", "_h1").agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "row")])
    return once.unionByName(unpacked(same, docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; repeated rows are judged alike; texts of any
    length are read whole; an empty table gives an empty one; extra columns stay, whatever their names."""
    found = decontam.screened(packed(docs, "text"), table(spark, sf_dir, "benchmark"))
    return unpacked(found.filter(F.size("leaks") == 0), docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask in the text; documents stay. Null and empty texts have none and stay as they are;
    repeated rows are masked alike; a text of any length is one row, masked in time in proportion to it; equal p-values are
    accepted or left together; an empty table gives an empty one; extra columns stay, whatever their names."""
    found = secrets.scan(packed(docs, "text"))
    text = secrets.redacted(F.col("text"), F.col("spans"))
    masked = found.select("row", text.alias("text"), (F.size("spans") > 0).alias("hit"))
    return unpacked(masked, docs, n_chars=F.when(F.col("hit"), F.length("text").cast("long")).otherwise(F.col("row.n_chars")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they decode to its bytes. Null and empty texts have no ids and decode; repeated
    rows stay; an empty table gives an empty one; extra columns are left out."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bytebpe.coded(docs, path)
    return rows.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.coalesce(F.col("decoded") == F.col("text").cast("binary"), F.octet_length("decoded") == 0).alias("round_trip"),
    )


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("byte_bpe", byte_bpe),
]
#: SQL can't express trained models, xxHash64 links and tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Between stages the rows are written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settled(docs)
    return docs
