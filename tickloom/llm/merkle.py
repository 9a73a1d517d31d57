"""A Merkle manifest of a dataset: a digest for each row, folded up to one root, with a proof for every row.

Rows of a group, in order, are the leaves of a tree of runs of RUN nodes. Leaves are dealt by aligned blocks of
RUN ** levels; within a block a postorder recursion returns each subtree's digest and, while unwinding, appends the
siblings of each of its parts to the leaves that the part contains. The blocks' roots are the nodes of another such
distributed traversal, until a group has one node; the groups' roots, in order, are the leaves of a last tree.

Texts are hashed where they are read; only digests travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blocks import ROWS_A_BLOCK, ordered_blocks
from ..session import settled
from .common import hot_keys, joined, only, table

#: Consecutive nodes that become one.
RUN = 3
#: Levels that one block folds: a block has RUN ** LEVELS nodes.
LEVELS = 7
#: The columns that a leaf is made of, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<at:tinyint,others:array<binary>>>"


def leaf(fields: dict[str, Column] | tuple[str, ...] = FIELDS) -> Column:
    """sha256, in hexadecimal, of each field's byte count, a colon and the value, or `-` for a null."""
    values = list(fields.values()) if isinstance(fields, dict) else [F.col(c) for c in fields]
    texts = [v.cast("string") for v in values]
    told = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def digest_of(nodes: list[bytes]) -> bytes:
    """The digest of a run: of its nodes' hexadecimal texts, one after the other."""
    return sha256("".join(x.hex() for x in nodes).encode()).digest()


def subtree(digests: list[bytes], paths: list[list[tuple[int, list[bytes]]]], start: int, level: int) -> bytes:
    """The digest of the subtree of so many levels that begins at a leaf. Postorder: the parts' digests are known before
    the run's; unwinding, each part's siblings are appended to the paths of the leaves that it contains."""
    if level == 0:
        return digests[start]
    width = RUN ** (level - 1)
    starts = range(start, min(start + RUN * width, len(digests)), width)
    parts = [subtree(digests, paths, s, level - 1) for s in starts]
    for at, s in enumerate(starts):
        step = (at, parts[:at] + parts[at + 1 :])
        for path in paths[s : s + width]:
            path.append(step)
    return digest_of(parts)


def _height(n: int) -> int:
    """Levels over n nodes."""
    level = 0
    while RUN**level < n:
        level += 1
    return level


def _tier(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes (_g, _i, _n, _digest and others) with _b, their block, _path, the siblings inside it, and _top, its root.

    A block of a group with more nodes than a block holds is folded by all levels, another to the group's root.
    """
    size = RUN**levels
    others = [c for c in nodes.columns if c not in ("_g", "_i", "_n", "_digest")]
    dealt = nodes.select("_g", "_i", "_n", "_digest", *others, F.floor(F.col("_i") / size).alias("_b")).repartition("_g", "_b").sortWithinPartitions("_g", "_b", "_i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            block = pa.Table.from_batches(held).combine_chunks()
            digests, n = block.column("_digest").to_pylist(), block.column("_n")[0].as_py()
            paths: list[list] = [[] for _ in digests]
            top = subtree(digests, paths, 0, levels if n > size else _height(n))
            steps = [[{"at": at, "others": rest} for at, rest in path] for path in paths]
            kind = pa.list_(pa.struct([("at", pa.int8()), ("others", pa.list_(pa.binary()))]))
            out = block.append_column("_path", pa.array(steps, kind)).append_column("_top", pa.array([top] * len(digests), pa.binary()))
            return out.combine_chunks().to_batches()[0]

        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, blocks = batch.column("_g").to_pylist(), batch.column("_b").to_pylist()
            begun = 0
            for i, key in enumerate(zip(groups, blocks, strict=True)):
                if key != at:
                    if i > begun:
                        held.append(batch.slice(begun, i - begun))
                    if held:
                        yield done()
                    held, at, begun = [], key, i
            held.append(batch.slice(begun))
        if held:
            yield done()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return settled(dealt.mapInArrow(run, f"{schema}, _path {PATH}, _top binary"))


def numbered(rows: DataFrame, order: list[str], rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """rows with _i, their number from 0 in their group _g by the order, and _n, the rows of the group.

    A group is cut into blocks of its order, counts of (group, block) tell where each begins, and rows are numbered within
    their block: no task sees a whole group. Rows that are equal in the order follow each other in any way.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())  # equal rows can be cut apart too
    placed = ordered_blocks(tied, ["_g", *order, "_tie"], rows_a_block)
    counts = placed.groupBy("_g", "_block").agg(F.count("*").alias("_rows"))
    of = W.partitionBy("_g")
    spans = counts.select("_g", "_block", F.coalesce(F.sum("_rows").over(of.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"), F.sum("_rows").over(of).alias("_n"))
    inner = F.row_number().over(W.partitionBy("_g", "_block").orderBy(*order, "_tie")) - 1
    return placed.withColumn("_row", inner).join(spans, ["_g", "_block"]).withColumn("_i", F.col("_first") + F.col("_row")).drop("_row", "_first", "_tie", "_block")


def _above(tiers: list[DataFrame], levels: int) -> DataFrame:
    """_g, _b: the blocks of the first tier; _rest: the siblings from the block's root up; _subroot: the group's root."""
    size = RUN**levels
    found = None
    for rows in reversed(tiers):
        ends = rows.filter((F.col("_i") % size == 0) & (F.col("_n") <= size)).select("_g", "_b", F.lit(None).cast(PATH).alias("_rest"), F.col("_top").alias("_subroot"))
        found = ends if found is None else ends.unionByName(found)
        if rows is not tiers[0]:  # a node here is a block of the tier below
            found = rows.join(found, ["_g", "_b"]).select("_g", F.col("_i").alias("_b"), _joined_paths("_path", "_rest").alias("_rest"), "_subroot")
    return found


def _joined_paths(*paths: str) -> Column:
    none = F.array().cast(PATH)
    return F.concat(*[F.coalesce(F.col(p), none) for p in paths])


def trees(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The tree of each group of nodes (_g, _i, _n, _digest and others).

    Returns the nodes with _b and _path (siblings inside the block), and the blocks: _g, _b, _rest (siblings from there
    up) and _subroot, the group's root.
    """
    size, tiers = RUN**levels, []
    while True:
        rows = _tier(nodes, levels)
        tiers.append(rows)
        nodes = rows.filter((F.col("_i") % size == 0) & (F.col("_n") > size)).select("_g", F.floor(F.col("_i") / size).alias("_i"), F.ceil(F.col("_n") / size).alias("_n"), F.col("_top").alias("_digest"))
        if nodes.isEmpty():
            return tiers[0].drop("_top"), _above(tiers, levels)


def folded(node: Column, path: Column) -> Column:
    """The root that a node's digest (hexadecimal) and its path give."""
    texts = lambda nodes: F.transform(nodes, lambda x: F.lower(F.hex(x)))

    def up(node: Column, step: Column) -> Column:
        others, at = texts(step["others"]), step["at"].cast("int")
        run = F.concat(F.slice(others, F.lit(1), at), F.array(node), F.slice(others, at + 1, F.size(others) - at))
        return F.sha2(F.array_join(run, "").cast("binary"), 256)

    return F.aggregate(path, node, up)


def siblings(path: Column) -> Column:
    """The siblings of a path, level by level and left to right, in hexadecimal."""
    return F.transform(F.flatten(F.transform(path, lambda step: step["others"])), lambda x: F.lower(F.hex(x)))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "source", order_col: str = "doc_id", changed: dict[str, Column] | None = None, levels: int = LEVELS, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """A row per input row: order_col, leaf, changed_leaf, subroot, root (hexadecimal) and path, the proof.

    A group's leaves ascend by order_col (null first), then by digest; groups ascend by name (null first, by bytes).
    changed gives columns another value: changed_leaf is the digest of the row as it would be then, to be held against
    the manifest. Repeated rows are leaves of their own and get the paths of their places; null and empty texts, and
    texts of any length, are hashed like any other; an empty table gives an empty one; other columns are left out.
    """
    rows = only(docs, *fields)
    own = {c: F.col(c) for c in fields}
    group = F.when(F.col(group_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string")))
    hashed = settled(rows.select(F.col(order_col).alias("_order"), group.alias("_g"), F.unhex(leaf(own)).alias("_digest"), F.unhex(leaf(own | (changed or {}))).alias("_changed")))
    rows, blocks = trees(numbered(hashed, ["_order", "_digest"], rows_a_block), levels)
    roots = blocks.filter("_b = 0").select(F.lit("").alias("_g"), F.col("_g").alias("_name"), F.col("_subroot").alias("_digest"))
    tops, upper = trees(numbered(roots, ["_name"], rows_a_block), levels)
    of_groups = tops.join(upper, ["_g", "_b"]).select(F.col("_name").alias("_g"), _joined_paths("_path", "_rest").alias("_up"), F.col("_subroot").alias("_root"))
    ways = settled(blocks)
    met = joined(ways, of_groups, "_g", hot_keys(ways, "_g")).select("_g", "_b", _joined_paths("_rest", "_up").alias("_rest"), "_subroot", "_root")
    hexed = lambda c: F.lower(F.hex(c))
    return rows.join(met, ["_g", "_b"]).select(
        F.col("_order").alias(order_col),
        hexed("_digest").alias("leaf"),
        hexed("_changed").alias("changed_leaf"),
        hexed("_subroot").alias("subroot"),
        hexed("_root").alias("root"),
        _joined_paths("_path", "_rest").alias("path"),
    )


def verified(rows: DataFrame) -> DataFrame:
    """A manifest's rows with proof_sha256 (of all siblings), folded_root (by changed_leaf and the path) and verified."""
    proof = F.sha2(F.array_join(siblings(F.col("path")), "").cast("binary"), 256)
    told = rows.select("*", proof.alias("proof_sha256"), folded(F.col("changed_leaf"), F.col("path")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = verified(manifest(table(spark, sf_dir, "documents"), changed={"text": tampered}))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def oracle() -> str:
    """DuckDB SQL: trees level by level, siblings by run, and the fold along each leaf's steps."""
    told = " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS[:-1])
    text = lambda t: f"coalesce(CAST(strlen({t}) AS VARCHAR) || ':' || {t}, '-')"
    # the state of CRC-32 before its last inversion, bit by bit
    crc = "list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"
    return f"""WITH RECURSIVE leaves AS (SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS g, sha256({told} || {text('text')}) AS leaf, CASE WHEN {crc} & 1 = 1 THEN sha256({told} || {text("replace(text, chr(10), '')")}) ELSE sha256({told} || {text('text')}) END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS r FROM leaves),
nodes AS (SELECT 0 AS level, g, i, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM placed
  UNION ALL SELECT level + 1, g, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (min(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY level, g, i // 3),
subs AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS k, count(*) OVER () AS m FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, k, subroot AS digest, m FROM subs UNION ALL SELECT level + 1, k // 3, sha256(string_agg(digest, '' ORDER BY k)), (min(m) + 2) // 3 FROM tops WHERE m > 1 GROUP BY level, k // 3),
steps AS (SELECT r, o.level AS level, o.i AS place, o.digest, p.i // CAST(3 ** o.level AS BIGINT) AS own FROM placed p JOIN nodes o ON o.g = p.g AND o.n > 1 AND o.i // 3 = p.i // CAST(3 ** (o.level + 1) AS BIGINT)
  UNION ALL SELECT r, 1000 + o.level, o.k, o.digest, s.k // CAST(3 ** o.level AS BIGINT) FROM placed p JOIN subs s ON s.g = p.g JOIN tops o ON o.m > 1 AND o.k // 3 = s.k // CAST(3 ** (o.level + 1) AS BIGINT)),
runs AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY level) AS step, coalesce(string_agg(digest, '' ORDER BY place) FILTER (WHERE place < own), '') AS before, coalesce(string_agg(digest, '' ORDER BY place) FILTER (WHERE place > own), '') AS after FROM steps GROUP BY r, level),
proofs AS (SELECT r, sha256(coalesce(string_agg(before || after, '' ORDER BY step), '')) AS proof_sha256 FROM placed LEFT JOIN runs USING (r) GROUP BY r),
folds AS (SELECT r, 0 AS step, changed AS digest FROM placed UNION ALL SELECT f.r, u.step, sha256(before || digest || after) FROM folds f JOIN runs u ON u.r = f.r AND u.step = f.step + 1),
ends AS (SELECT r, arg_max(digest, step) AS folded_root FROM folds GROUP BY r)
SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE m = 1) AS root, proof_sha256, folded_root, folded_root = (SELECT digest FROM tops WHERE m = 1) AS verified FROM placed JOIN subs USING (g) JOIN proofs USING (r) JOIN ends USING (r)"""
