"""Document fingerprints: a canonical exact digest.

Texts are brought to one form (NFKC with full case folding, runs of white space as one space, trimmed) and hashed by two
chained xxHash64 to 128 bits. Texts whose form is equal have equal fingerprints; inside a bucket of equal digests the
bytes are compared, and a bucket that holds different bytes is told apart by rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import only, passing_shuffles, table
from .unicodeform import normal

#: Code points whose rows one task holds at once when it looks at the next document.
CHARS_PER_BLOCK = 2_000_000
#: Blocks at most, so that their first rows are few enough to broadcast; beyond, blocks grow and spill.
MOST_BLOCKS = 1 << 16
#: Quantiles at most that cut the ids; between two, ids are cut evenly.
MOST_CUTS = 512


def canonical(text: Column) -> Column:
    """The form under which texts count as equal; null counts as empty."""
    form = normal(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(form, r"[\s\x{85}\x{200B}\x{FEFF}\p{Z}]+", " "))


def digest(form: Column) -> Column:
    """128 bits as 32 hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(salt), form)), 16, "0") for salt in ("high", "low")]))


def collisions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Buckets of equal digests that hold different bytes: digest, form, rank from 1. Empty but for a true collision.

    Grouping by digest and form compares the bytes inside each bucket; equal texts, however many, leave each map task
    as one row, so a text that a third of all rows hold makes no hot task.
    """
    form = canonical(F.col(text_col))
    forms = only(docs, text_col).select(digest(form).alias("digest"), form.alias("form")).groupBy("digest", "form").agg(F.count("*").alias("n"))
    several = forms.groupBy("digest").agg(F.count("*").alias("n_forms")).filter("n_forms > 1").select("digest")
    rank = F.row_number().over(W.partitionBy("digest").orderBy("form"))
    return forms.join(several, "digest", "left_semi").select("digest", "form", rank.alias("rank"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_per_block: int = CHARS_PER_BLOCK) -> DataFrame:
    """id, text and next_text, the text of the next row by ascending (id, text); after the last row comes the first.

    Null ids come first. Ids are cut into blocks of about chars_per_block, at quantiles and evenly between them; each
    block also gets the first row of the block after it, so the next row is found inside a block and no task sees the
    whole order. A block is a window that spills; its rows alone are sorted.
    """
    rows = only(docs, id_col, text_col).select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    n, chars = rows.select(F.count("*"), F.sum(F.length("_text"))).first()
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = min(n or 1, MOST_BLOCKS, max(partitions, -(-(chars or 0) // chars_per_block)))
    ranges = min(blocks, MOST_CUTS)
    low, high, quantiles = rows.select(F.min(id_col), F.max(id_col), F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges)).first()
    cuts = sorted(set(quantiles or [])) if ranges > 1 else []
    parts = -(-blocks // ranges)

    def range_of(lo: int, hi: int) -> Column:
        """The number of cuts below the id, by halving; a null id is in the first range."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(id_col) > F.lit(cuts[mid]), range_of(mid + 1, hi)).otherwise(range_of(lo, mid))

    block = range_of(0, len(cuts)).cast("long")
    if parts > 1:
        edges = F.array(*[F.lit(float(x)) for x in [low, *cuts, high]])
        begin, end = edges[block.cast("int")], edges[block.cast("int") + 1]
        within = F.floor((F.col(id_col).cast("double") - begin) / F.greatest(end - begin, F.lit(1.0)) * parts)
        block = block * parts + F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.coalesce(within, F.lit(0)))).cast("long")
    order = F.struct(F.col(id_col), F.col("_text"))
    placed = rows.withColumn("_block", block)
    # the first row of each block, by its narrow key, moves to the block before; the very first to the last block
    firsts = placed.groupBy("_block").agg(F.min(F.struct(F.coalesce(F.col(id_col).isNotNull(), F.lit(False)).alias("known"), F.col(id_col).alias("id"))).alias("first"))
    ring = W.orderBy("_block")
    guards = firsts.select(
        F.col("first.id").alias("_first_id"),
        F.col("_block").alias("_own"),
        F.coalesce(F.lag("_block").over(ring), F.max("_block").over(W.partitionBy())).alias("_to"),
        F.lag("_block").over(ring).isNull().cast("int").alias("_wraps"),
    )
    guard_rows = (
        placed.join(F.broadcast(guards), (F.col("_block") == F.col("_own")) & F.col(id_col).eqNullSafe(F.col("_first_id")))  # as many rows as blocks
        .groupBy("_own", "_to", "_wraps", id_col)
        .agg(F.min("_text").alias("_text"))
        .select(id_col, "_text", F.col("_to").alias("_block"), (F.col("_wraps") + 1).alias("_guard"))
    )
    both = placed.select(id_col, "_text", "_block", F.lit(0).alias("_guard")).unionByName(guard_rows)
    following = W.partitionBy("_block").orderBy("_guard", order)
    return both.withColumn("next_text", F.lead("_text").over(following)).filter("_guard = 0").select(id_col, F.col("_text").alias(text_col), "next_text")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint, copies: the fingerprint of every text and how many rows share it.

    Null and empty texts share the fingerprint of the empty form. Repeated rows stay; an empty table gives an empty one.
    """
    rows = only(docs, id_col, text_col)
    form = canonical(F.col(text_col))
    marked = _told_apart(rows.select(id_col, digest(form).alias("fingerprint"), form.alias("form")), docs, text_col).drop("form")
    return marked.join(marked.groupBy("fingerprint").agg(F.count("*").alias("copies")), "fingerprint").select(id_col, "fingerprint", "copies")


def _told_apart(marked: DataFrame, docs: DataFrame, text_col: str, found: DataFrame | None = None) -> DataFrame:
    """Adds a rank to the fingerprints of the rows in buckets that hold different bytes, if there are such buckets."""
    found = collisions(docs, text_col) if found is None else found
    with passing_shuffles(docs.sparkSession):
        if found.isEmpty():
            return marked
    ranks = found.select(F.col("digest").alias("fingerprint"), "form", "rank")
    return marked.join(ranks, ["fingerprint", "form"], "left").withColumn("fingerprint", F.concat_ws("-", "fingerprint", "rank")).drop("rank")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the start of the next document.

    Null texts count as empty; null ids come first; a table of one row is its own next document; repeated rows follow each
    other; other columns are left out, so they can't clash; an empty table gives an empty one. Digests that agree are confirmed on the forms' bytes, which stand in
    the same row; across rows, collisions() compares them.
    """
    text, other = F.col(text_col), F.col("next_text")
    n = F.length(text)
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - part), F.substring(other, F.lit(1), part))
    rows = with_next(docs, id_col, text_col).select(
        id_col,
        n.cast("long").alias("n_chars"),
        F.sha2(edited.cast("binary"), 256).alias("edited_sha256"),
        # one expression for the three of them: it is large, and each copy would be planned and sent on its own
        F.transform(F.array(text, edited, other), canonical).alias("_forms"),
    ).select("*", F.col("_forms")[0].alias("form"), F.col("_forms")[1].alias("edited_form"), F.col("_forms")[2].alias("next_form"))
    marked = rows.select("*", digest(F.col("form")).alias("fingerprint"), digest(F.col("edited_form")).alias("edited_digest"), digest(F.col("next_form")).alias("next_digest"))
    marked = _told_apart(marked, docs, text_col)
    same = lambda form, own: F.when((F.col(own) == F.substring("fingerprint", 1, 32)) & (F.col(form) == F.col("form")), 1.0).otherwise(0.0)
    return marked.select(
        id_col,
        "n_chars",
        "edited_sha256",
        "fingerprint",
        F.when(F.col("edited_form") == F.col("form"), F.col("fingerprint")).otherwise(F.col("edited_digest")).alias("edited_fingerprint"),
        same("edited_form", "edited_digest").alias("near_edited"),
        same("next_form", "next_digest").alias("near_next"),
    )


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
