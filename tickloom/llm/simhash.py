"""SimHash near-duplicates by a Gray-order hierarchical index.

Every text gets a fingerprint of one or more 64-bit words from the hashes of its word shingles. In the index, upper
nodes are shared masked bit patterns: codes meet in the node of every mask under which their bits agree. A node's codes
are sorted by Gray rank, runs of them are factored into a tree whose nodes keep the bits that all below share (mask and
pattern), and pairs of nodes whose shared bits already differ too much are pruned whole. A node hands on a spanning
forest of its links, so thousands of near copies don't become millions of pairs.

For a small radius the masks are exact: of `radius + f` blocks of bits, f are equal in two linked codes, so both meet in
the upper node of some choice of f blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hot_keys, hot_limit, joined, only, table

#: Children of a node of the tree.
FANOUT = 16
#: Pairs that one step of the search expands at once.
PAIRS_AT_ONCE = 1 << 18
#: Codes of an upper node beyond which it is divided again by other masks.
NODE_LIMIT = 20_000
#: Oversized nodes at most: the limit grows with the rows, so that their keys are few enough to broadcast.
MOST_LARGE = 100_000
#: One mask for each word of a code.
Mask = tuple[int, ...]


def shingle_hashes(text: str | None, words_a_shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle in order, repeats included; of fewer words, of the whole sequence; none of no words."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    k = min(words_a_shingle, len(words))
    starts = [0, *(e + 1 for e in ends[: len(words) - k])]
    return np.fromiter((xxhash.xxh64_intdigest(whole[s:e], seed) for s, e in zip(starts, ends[k - 1 :], strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of rows of hashes, one or more words wide: bits that are set in over half of them."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for a in range(0, len(hashes), 255):  # so many add up inside a byte
        ones += np.unpackbits(hashes[a : a + 255].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def simhash(text: str | None, words_a_shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text, unsigned; 0 for a text without words."""
    return int(majority(shingle_hashes(text, words_a_shingle, seed).reshape(-1, 1))[0])


def fingerprints(docs: DataFrame, words_a_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and code, the fingerprint as a signed long, of every row. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter((simhash(t.as_py(), words_a_shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], names=[id_col, "code"])

    rows = only(docs, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, code bigint")


def gray_rank(code: Column) -> Column:
    """The place of a code in Gray order, as a long that sorts like it."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(blocks: int, radius: int, bits: list[int]) -> list[Mask]:
    """Bit masks of every choice of blocks - radius of the blocks into which the given bits are cut."""
    cuts = [bits[i * len(bits) // blocks : (i + 1) * len(bits) // blocks] for i in range(blocks)]
    return [(signed(sum(1 << b for cut in chosen for b in cut)),) for chosen in combinations(cuts, blocks - radius)]


def blocks_for(n: int, radius: int) -> int:
    """As few blocks as keep an upper node at about 64 of n evenly spread fingerprints."""
    blocks = radius + 1
    while n / 2 ** (64 * (blocks - radius) / blocks) > 64 and blocks < 2 * radius:
        blocks += 1
    return blocks


def exact_levels(n: int, radius: int) -> list[list[Mask]]:
    """Masks of the upper nodes, and those that divide oversized nodes again and again. Each level loses no link."""
    spread = [b * 37 % 64 for b in range(64)]  # other neighbours than in order
    return [masks(blocks_for(n, radius), radius, list(range(64))), masks(2 * radius, radius, spread), masks(2 * radius, radius, sorted(range(64), key=lambda b: (b % 8, b)))]


def _tree(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of (shared-bit masks, patterns), from the codes up; FANOUT nodes of a level share a node above."""
    levels = [(np.full(codes.shape, ~np.uint64(0)), codes)]
    while len(levels[-1][0]) > FANOUT:
        mask, pattern = levels[-1]
        at = np.arange(0, len(mask), FANOUT)
        every, some = np.bitwise_and.reduceat(pattern, at), np.bitwise_or.reduceat(pattern, at)
        shared = np.bitwise_and.reduceat(mask, at) & ~(every ^ some)
        levels.append((shared, every & shared))
    return levels


def _near(codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of codes (rows of words), in Gray order, within the radius; a bounded number at once."""
    levels = _tree(codes)
    top = len(levels) - 1
    i, j = np.triu_indices(len(levels[top][0]))
    stack = [(top, i, j)]
    while stack:
        level, i, j = stack.pop()
        mask, pattern = levels[level]
        apart = np.zeros(len(i), np.int64)  # differences accumulate word by word
        for w in range(codes.shape[1]):
            p, m = pattern[:, w], mask[:, w]
            apart += np.bitwise_count(p[i] ^ p[j] if level == 0 else (p[i] ^ p[j]) & m[i] & m[j])
            if w + 1 < codes.shape[1]:
                near = apart <= radius
                i, j, apart = i[near], j[near], apart[near]
        near = apart <= radius
        i, j = i[near], j[near]
        if level == 0:
            yield i[i < j], j[i < j]
            continue
        below, step = len(levels[level - 1][0]), max(1, PAIRS_AT_ONCE // FANOUT**2)
        for a in range(0, len(i), step):
            x = (i[a : a + step, None, None] * FANOUT + np.arange(FANOUT)[None, :, None]).repeat(FANOUT, 2).ravel()
            y = (j[a : a + step, None, None] * FANOUT + np.arange(FANOUT)[None, None, :]).repeat(FANOUT, 1).ravel()
            ok = (x < below) & (y < below) & (x <= y)
            stack.append((level - 1, x[ok], y[ok]))


def _forest(names: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of codes as (name, another name of its part): a tree for each part, no row with many links."""
    root = np.arange(len(codes))
    for i, j in _near(codes, radius):
        while len(i):
            i, j = root[i], root[j]
            apart = i != j
            i, j = np.minimum(i[apart], j[apart]), np.maximum(i[apart], j[apart])
            if len(i):
                np.minimum.at(root, j, i)
                while (root[root] != root).any():
                    root = root[root]
    order = np.argsort(root, kind="stable")
    first = np.concatenate([[True], root[order][1:] != root[order][:-1]])
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    # the k-th of a part hangs on its (k - 1) // 2-th, as in a heap
    child = np.flatnonzero(place > 0)
    parent = child - place[child] + (place[child] - 1) // 2
    return names[order[child]], names[order[parent]]


def _links_in_nodes(routed: DataFrame, words: list[str], radius: int) -> DataFrame:
    """Rows dealt by their node (key) and sorted by Gray rank there -> links (a, b)."""
    wide = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at: int | None = None

        def done() -> pa.RecordBatch | None:
            rows = np.concatenate(held)
            if len(rows) < 2:
                return None
            a, b = _forest(rows[:, 0], np.ascontiguousarray(rows[:, 1 : wide + 1]).view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]) if len(a) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            rows = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for s, e in zip(edges, edges[1:], strict=False):
                if at is not None and key[s] != at:
                    if (out := done()) is not None:
                        yield out
                    held = []
                at = key[s]
                held.append(rows[s:e])
        if held and (out := done()) is not None:
            yield out

    dealt = routed.repartition("key").sortWithinPartitions("key", *[gray_rank(F.col(w)) for w in words])
    return dealt.select("key", "code", *words).mapInArrow(run, "a bigint, b bigint")


def node_links(codes: DataFrame, levels: list[list[Mask]], words: list[str], radius: int, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Links (a, b) between the distinct `code`s whose words differ in at most radius bits, as far as masks bring them
    together: of each node a spanning forest, which joins as all pairs would.

    Nodes of more than node_limit codes are divided by the next level's masks, as long as there are levels; keys are
    hashes, and two nodes of one hash are searched as one.
    """
    patterns = lambda chosen, *more: F.explode(F.array(*[F.xxhash64(*more, F.lit(i), *[F.col(w).bitwiseAND(F.lit(m)) for w, m in zip(words, mask, strict=True)]) for i, mask in enumerate(chosen)])).alias("key")
    held = ["code", *words]
    routed, found = codes.select(*held, patterns(levels[0])), None
    for chosen in [*levels[1:], None]:
        large = None
        if chosen is not None:
            sizes = checkpointed(routed.groupBy("key").count().filter(F.col("count") > node_limit))
            limit = max(node_limit, (sizes.agg(F.sum("count")).first()[0] or 0) // MOST_LARGE)
            large = sizes.filter(F.col("count") > limit).select("key")
            if large.isEmpty():
                large = None
        fit = routed if large is None else routed.join(F.broadcast(large), "key", "left_anti")  # MOST_LARGE keys at most
        links = _links_in_nodes(fit, words, radius)
        found = links if found is None else found.unionByName(links)
        if large is None:
            return found
        routed = checkpointed(routed.join(F.broadcast(large), "key", "left_semi").withColumnRenamed("key", "_up").select(*held, patterns(chosen, F.col("_up"))))
    return found


def links(codes: DataFrame, radius: int = 4, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Links (a, b) that join the distinct 64-bit `code`s as all pairs within the radius would: every link is one, none
    between parts is lost."""
    return node_links(codes.select("code", F.col("code").alias("word")), exact_levels(codes.count(), radius), ["word"], radius, node_limit)


def _roots(both: DataFrame) -> DataFrame:
    """node and label: the end of the chain of least neighbours that begins at the node. Labels jump to their label's label."""
    stepped = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.first("a").alias("old"), F.least(F.first("a"), F.min("b")).alias("label")))
    limit = hot_limit(stepped.count())
    while True:
        labels = stepped.select("node", "label")
        sizes = stepped.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("old") != F.col("label")).alias("moved"))
        moved, hot = sizes.agg(F.sum("moved"), F.collect_list(F.when(F.col("n") > limit, F.col("label")))).first()
        if not moved:
            return labels
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        stepped = checkpointed(joined(labels, further, "label", hot).select("node", F.col("label").alias("old"), F.col("further").alias("label")))


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node and label, the least node that it is joined to, for every node of the edges (a, b).

    Every node goes along its chain of least neighbours, and what came together is one node of the next round, so each
    edge is looked up once or twice, however large its part is. Every round ends in a checkpoint. A node with very many
    edges and a label with very many nodes are joined apart from the others, so that neither makes a hot task.
    """
    ways = edges.filter("a <> b").select("a", "b")
    both = checkpointed(ways.unionByName(ways.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names: DataFrame | None = None
    for _ in range(rounds):
        roots = _roots(both)
        of = lambda node, root: roots.select(F.col("node").alias(node), F.col("label").alias(root))  # noqa: B023, E731
        names = roots if names is None else checkpointed(joined(names, of("label", "root"), "label", how="left").select("node", F.coalesce("root", "label").alias("label")))
        hubs = hot_keys(both, "a")  # edges go both ways
        met = joined(joined(both, of("a", "root_a"), "a", hubs), of("b", "root_b"), "b", hubs)
        both = checkpointed(met.filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
        if both.isEmpty():
            return names
    raise RuntimeError(f"edges are left after {rounds} rounds")


def near_duplicates(docs: DataFrame, words_a_shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", node_limit: int = NODE_LIMIT) -> DataFrame:
    """A row per input row: id, code (the fingerprint as a signed long), component_id (the least id reachable by links).

    Null, empty and wordless texts have fingerprint 0 and are linked like any other; texts with equal fingerprints are
    always linked; repeated rows stay; null ids never name a component unless all its ids are null. An empty table
    gives an empty one; other columns are left out.
    """
    prints = checkpointed(fingerprints(docs, words_a_shingle, id_col, text_col))
    firsts = checkpointed(prints.groupBy("code").agg(F.min(id_col).alias("first_id")))
    linked = components(links(firsts.select("code"), radius, node_limit))
    parts = checkpointed(firsts.join(linked.withColumnRenamed("node", "code"), "code", "left").select("code", "first_id", F.coalesce("label", "code").alias("label")))
    named = parts.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = joined(parts, named, "label").select("code", "component_id")
    return joined(prints, classes, "code").select(id_col, "code", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
