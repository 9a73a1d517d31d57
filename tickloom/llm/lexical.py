"""Ranked lexical search: BM25 in whole numbers over a table of postings.

Postings are a table of (document, bucket of the term, term, occurrences, length of the document). Dealt by document and,
within a part, ordered by term bucket, so that all postings of a document meet in one task: item terms come to them, each
match is scored, and a document's scores for an item are summed where they arise. Dealt by term alone, every match would
travel: a document has some hundred terms, but matches a term with every item that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settled
from .common import only, table
from .urlfilter import CAPITALS, SMALL

#: Fixed value: what stands between terms; all else, letters and digits of ASCII and all beyond it, makes terms.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Buckets of terms.
BUCKETS = 64
#: Bytes of item terms that are broadcast at once; items beyond are asked in further blocks.
BLOCK_BYTES = 16 << 20
#: Bytes that a task holds for a term of an item: the term, its weight, an item's name, and the hash table around them.
TERM_BYTES = 200


def terms(text: Column) -> Column:
    """All terms of a text, in order; only A-Z are lower-cased. Null has none."""
    split = F.split(F.translate(text, CAPITALS, SMALL), BETWEEN)  # empty texts stand at its ends alone
    return F.coalesce(F.array_remove(split, ""), F.array().cast("array<string>"))


def lengths(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms."""
    n = F.size(terms(F.col(text_col))).cast("long")
    return tuple(only(docs, text_col).select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first())


def postings(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number for each row), id, n, bucket, term, tf of the documents' terms that stand in the vocabulary (term).

    Written once: row numbers are those of one reading. The vocabulary is joined by its size: Spark broadcasts it where it
    is small, else both sides meet by term. A document's terms are counted where it is read, before they are shuffled.
    """
    rows = only(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), terms(F.col(text_col)).alias("_terms"))
    told = rows.select("row", "id", F.size("_terms").cast("long").alias("n"), F.explode("_terms").alias("term")).join(vocabulary, "term", "left_semi")
    counted = told.groupBy("row", "term").agg(F.count("*").alias("tf"), F.first("id").alias("id"), F.first("n").alias("n"))
    return settled(counted.select("row", "id", "n", bucket(F.col("term")), "term", "tf"))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item, rank, id, score: each item's k highest-scoring documents among those with a score above 0, rank from 1,
    equal scores by ascending id (null first).

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a match adds weight * (10^9 tf div (1000 tf + 20 m)), where m
    is 50 + (50 n N) div L. Repeated rows are documents of their own and take a rank each; rows of one item id are one
    item of all their terms, a null id among them; null, empty and wordless texts and items have no rows; an empty table
    of either kind gives an empty one. Long texts are rows like any other. Other columns are left out, so they can't clash.

    Items are asked in blocks whose terms take block_bytes at most to broadcast; every block reads all postings once. A
    task sums up whole documents, so that only its own k best of each item are shuffled.
    """
    asked = settled(only(items, item_col, item_text).select(F.col(item_col).alias("item"), F.explode(F.array_distinct(terms(F.col(item_text)))).alias("term")).distinct())
    n_docs, n_terms = lengths(docs, text_col)
    found = postings(docs, asked.select("term").distinct(), id_col, text_col)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    weighed = settled(asked.join(df, "term").select(bucket(F.col("term")), "term", "item", weight.alias("weight")))
    blocks = max(1, -(-weighed.count() * TERM_BYTES // block_bytes))
    m = F.lit(50) + F.expr(f"(50 * n * {n_docs}L) div {max(1, n_terms)}L")
    dealt = found.select("row", "id", "bucket", "term", (F.lit(1_000_000_000) * F.col("tf")).alias("_above"), (F.lit(1000) * F.col("tf") + F.lit(20) * m).alias("_below")).repartition("row").sortWithinPartitions("bucket", "term")
    best = None
    for i in range(blocks):
        own = weighed.filter(F.pmod(F.xxhash64(F.lit("block"), "item"), F.lit(blocks)) == i) if blocks > 1 else weighed
        by_term = own.groupBy("bucket", "term").agg(F.first("weight").alias("weight"), F.collect_list(F.struct("item")).alias("items"))  # in a struct, as lists leave nulls out
        met = dealt.join(F.broadcast(by_term), ["bucket", "term"])  # block_bytes at most
        matches = met.select("row", "id", F.inline("items"), F.expr("weight * (_above div _below)").alias("score"))
        summed = matches.groupBy("row", "item", "id").agg(F.sum("score").alias("score")).filter("score > 0")
        order = W.partitionBy("item").orderBy(F.desc("score"), F.asc("id"), "row")
        part = summed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best = part if best is None else best.unionByName(part)
    return best.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op13_lexical(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    found = r"regexp_extract_all(translate(text, '" + CAPITALS + "', '" + SMALL + r"'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {found} AS ts FROM documents WHERE text IS NOT NULL),
sums AS (SELECT count(*) AS big_n, CAST(sum(len(ts)) AS BIGINT) AS big_l FROM docs WHERE len(ts) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM docs) GROUP BY ALL),
items AS (SELECT DISTINCT item_id, unnest({found}) AS term FROM benchmark),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, sums GROUP BY term, big_n),
scores AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score FROM items JOIN weights USING (term) JOIN tf USING (term), sums GROUP BY 1, 2, 3),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, r) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""
