"""Near-duplicates by SimHash at a similarity of 0.8: the Gray-order index finds candidates, the shingles decide.

A text is the set of its five-word shingles; texts of equal sets have one code. Its fingerprint is a SimHash of 256 bits
over the set. Sets of Jaccard 0.8 differ in 15% of the bits, too many for the exact masks of a small radius; so upper
nodes are masks of some bits, drawn so often that a pair of Jaccard 0.8 meets in one with RECALL, and likelier pairs
more surely. Candidates are compared by their real shingles, and only pairs of Jaccard 0.8 or more are links.

Candidates joined by chains are a family, and a family's texts are compared in one task. A large family is dealt to many
tasks: each compares a part of it and some leaders of the whole family, which joins the bulk of tight copies. Whoever is
not of the family's largest class then is compared with all others in blocks of two parts, so that no task holds more and
no pair of different classes is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, joined, only
from .simhash import Mask, components, majority, node_links, shingle_hashes, signed

SHINGLE = 5  # words
#: Least Jaccard similarity of near duplicates, as a fraction.
LIKE = (4, 5)
WORDS = ["w0", "w1", "w2", "w3"]
BITS = 64 * len(WORDS)
#: Share of a fingerprint's bits in which two sets of Jaccard 0.8 differ: the angle between them, whose cosine is 8/9.
APART = float(np.arccos(2 * LIKE[0] / (LIKE[0] + LIKE[1])) / np.pi)
#: Bits in which candidates differ at most: Jaccard 0.8 gives more once in 1,500 pairs.
RADIUS = 58
#: Share of the pairs of Jaccard 0.8, the least likely to be found, that meet in a node.
RECALL = 0.95
#: Evenly spread codes of a node, about.
NODE = 512
#: Codes of a node beyond which it is divided again.
NODE_LIMIT = 8_000
#: Texts, and bytes of text, of a part of a family.
FAMILY, FAMILY_BYTES = 500, 8 << 20
#: Members of a large family, about, that all its parts are compared with.
LEADERS = 32


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    return np.unique(shingle_hashes(text, SHINGLE))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The WORDS of a set of hashes."""
    with np.errstate(over="ignore"):
        x = hashes[:, None] + np.arange(1, len(WORDS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return majority(np.ascontiguousarray(x ^ (x >> np.uint64(31))))


def met(bits: int, masks: int) -> float:
    """How likely two sets of Jaccard 0.8 are to agree on all bits of at least one of so many masks."""
    at = lambda d: comb(BITS, d) * APART**d * (1 - APART) ** (BITS - d)
    return sum(at(d) * (1 - (1 - comb(BITS - d, bits) / comb(BITS, bits)) ** masks) for d in range(RADIUS + 1))


def drawn_masks(bits: int, seed: int) -> list[Mask]:
    """As many masks of so many bits as RECALL needs. Their number grows with a power of the codes, about a quarter."""
    n = 1
    while met(bits, n) < RECALL:
        n += max(1, n // 16)
    rnd, out, left = np.random.default_rng(seed), [], np.zeros(0, int)
    while len(out) < n:  # masks of one shuffle of the bits share none
        if len(left) < bits:
            left = rnd.permutation(BITS)
        chosen, left = left[:bits].tolist(), left[bits:] if bits else left
        out.append(tuple(signed(sum(1 << (b % 64) for b in chosen if b // 64 == w)) for w in range(len(WORDS))))
    return out


def mask_levels(n: int) -> list[list[Mask]]:
    """Masks of the upper nodes of n codes, and those that divide nodes of too many like codes."""
    return [drawn_masks(max(0, ceil(log2(max(1, n) / NODE))), 1), drawn_masks(16, 2), drawn_masks(16, 3)]


def hashed(docs: DataFrame) -> DataFrame:
    """docs with _h0 and _h1, 128 bits of all that a row holds. Null hashes as nothing, so which are null is hashed too; a
    column that holds a map, which Spark doesn't hash, is hashed as JSON."""
    names = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in names])
    return docs.withColumns({f"_h{i}": F.xxhash64(F.lit(i), nulls, *names) for i in range(2)})


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_h0, _h1 and id of every row of hashed docs, its code, the words of its fingerprint and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, words = np.zeros(batch.num_rows, np.uint64), np.zeros((batch.num_rows, len(WORDS)), np.uint64)
            for i, text in enumerate(batch.column(3)):
                hashes = shingle_set(text.as_py())
                codes[i], words[i] = xxhash.xxh64_intdigest(hashes.tobytes()), fingerprint(hashes)
            made = [codes.view(np.int64), *words.view(np.int64).T]
            sizes = pc.fill_null(pc.binary_length(batch.column(3)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, made), sizes], names=["_h0", "_h1", id_col, "code", *WORDS, "n_bytes"])

    rows = only(docs, "_h0", "_h1", id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"_h0 bigint, _h1 bigint, `{id_col}` {kind}, code bigint, {', '.join(f'{w} bigint' for w in WORDS)}, n_bytes bigint")


def spanned(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first member of the part of each of 0..n-1, where near(i, others) tells which of the others are linked to i.

    Links inside a part are not asked for again, so a part of like members costs about one comparison each.
    """
    root, left = np.arange(n), np.arange(n)
    while len(left):
        first, left = left[0], left[1:]
        todo = [first]
        while todo and len(left):
            hit = near(todo.pop(), left)
            root[left[hit]] = first
            todo += left[hit].tolist()
            left = left[~hit]
    return root


def _by_shingles(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, first code of its part) between the texts of a part whose likeness is LIKE or more."""
    codes, new = np.unique(part.column(1).to_numpy(), return_index=True)
    sets = [shingle_set(part.column(2)[i].as_py()) for i in new.tolist()]
    sizes = np.array([len(s) for s in sets])
    # inverted: shingle -> the texts that have it, so that one text meets all others at once
    _, shingle = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    begins, order = np.concatenate([[0], np.cumsum(sizes)]), np.argsort(shingle, kind="stable")
    having, n = np.repeat(np.arange(len(sets)), sizes)[order], np.bincount(shingle)
    first = np.cumsum(n) - n

    def near(i: int, others: np.ndarray) -> np.ndarray:
        mine = shingle[begins[i] : begins[i + 1]]
        each, ends = n[mine], np.cumsum(n[mine])
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[mine] - ends + each, each)
        common = np.bincount(having[places], minlength=len(sets))[others]
        return LIKE[1] * common >= LIKE[0] * (sizes[i] + sizes[others] - common)

    root = spanned(len(codes), near)
    moved = root != np.arange(len(root))
    return codes[moved], codes[root[moved]]


def _in_parts(texts: DataFrame) -> DataFrame:
    """Rows of (key, code, text) dealt by key -> the links (a, b) of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            if sum(b.num_rows for b in held) > 1:
                a, b = _by_shingles(pa.Table.from_batches(held))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for s, e in zip(edges, edges[1:], strict=False):
                if held and held[-1].column(0)[-1].as_py() != key[s]:
                    yield from done()
                    held = []
                held.append(batch.slice(s, e - s))
        if held:
            yield from done()

    return texts.repartition("key").sortWithinPartitions("key", "code").mapInArrow(run, "a bigint, b bigint")


def _compared(docs: DataFrame, asked: DataFrame, text_col: str) -> DataFrame:
    """Links between the texts of asked (key, code, _h0, _h1) that share a key. Of rows that are the same, one comes."""
    pairs = ["_h0", "_h1"]
    wanted = only(docs, *pairs, text_col).join(asked.select(*pairs).distinct(), pairs, "left_semi").groupBy(*pairs).agg(F.first(text_col).alias("text"))
    return _in_parts(wanted.join(asked, pairs).select("key", "code", "text"))


def _families(members: DataFrame) -> DataFrame:
    """members (family, code, n_bytes ...) with how many members and tasks their family has."""
    members = checkpointed(members)
    sizes = members.groupBy("family").agg(F.count("*").alias("members"), F.sum("n_bytes").alias("_bytes"))
    parts = F.greatest(F.ceil(F.col("members") / FAMILY), F.ceil(F.col("_bytes") / F.lit(FAMILY_BYTES)), F.lit(1)).cast("int")
    return joined(members, sizes.select("family", "members", parts.alias("parts")), "family")


def likenesses(docs: DataFrame, firsts: DataFrame, text_col: str = "text") -> DataFrame:
    """Links (a, b) that join the codes of firsts (code, words, n_bytes, row) as all candidate pairs of LIKE or more would."""
    codes = firsts.select("code", *WORDS)
    likely = components(node_links(codes, mask_levels(firsts.count()), WORDS, RADIUS, NODE_LIMIT)).select(F.col("node").alias("code"), F.col("label").alias("family"))
    about = firsts.select("code", "n_bytes", "row._h0", "row._h1")
    members = checkpointed(_families(about.join(likely, "code")))
    small, large = members.filter("parts = 1"), members.filter("parts > 1")
    asked = small.select(F.col("family").alias("key"), "code", "_h0", "_h1")
    if large.isEmpty():
        return _compared(docs, asked, text_col)
    own = F.pmod(F.xxhash64("code"), F.col("parts"))
    leads = F.pmod(F.xxhash64("code", F.lit("leader")), F.col("members")) < LEADERS
    dealt = large.withColumn("part", F.explode(F.when(leads, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own.cast("int")))))
    found = checkpointed(_compared(docs, asked.unionByName(dealt.select(F.xxhash64("family", "part").alias("key"), "code", "_h0", "_h1")), text_col))
    classes = components(found).select(F.col("node").alias("code"), F.col("label").alias("class"))
    inside = checkpointed(large.join(classes, "code", "left").withColumn("class", F.coalesce("class", "code")))
    # narrow rows tell each family's largest class; whoever is in another meets all in blocks, the largest among itself not
    sizes = inside.groupBy("family", "class").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("family").agg(F.max_by("class", F.struct("n", "class")).alias("largest"), F.max("n").alias("_in"))
    marked = checkpointed(joined(inside, largest, "family").filter(F.col("_in") < F.col("members")))
    share = lambda n: F.ceil(F.col("parts") * n / F.col("members")).cast("int")
    counts = {"_few": share(F.col("members") - F.col("_in")), "_many": share(F.col("_in"))}
    is_few = F.col("class") != F.col("largest")
    block = marked.withColumns(counts).withColumn("own", F.pmod(F.xxhash64("code", F.lit("block")), F.when(is_few, F.col("_few")).otherwise(F.col("_many"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    key = lambda kind, i, j: F.xxhash64("family", F.lit(kind), i, j)
    own = F.col("own")
    among = F.transform(upto("_few"), lambda o: key("among", F.least(own, o), F.greatest(own, o)))
    against = F.transform(upto("_many"), lambda o: key("against", own, o))
    keys = F.when(is_few, F.concat(among, against)).otherwise(F.transform(upto("_few"), lambda o: key("against", o, own)))
    return found.unionByName(_compared(docs, block.select(F.explode(keys).alias("key"), "code", "_h0", "_h1"), text_col))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Of hashed docs, (_h0, _h1) of every row and (code, label, row) of every code.

    Codes of one label are joined by chains of near duplicates; row is the least of the code's rows, as (id is null, id,
    _h0, _h1). Null, empty and wordless texts are equal to each other; an empty table gives empty ones. Texts travel only
    where a code has a candidate.
    """
    made = checkpointed(prints(docs, id_col, text_col))
    row = F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col), "_h0", "_h1")
    firsts = checkpointed(made.groupBy("code").agg(F.min(row).alias("row"), *[F.first(x).alias(x) for x in (*WORDS, "n_bytes")]))
    linked = components(likenesses(docs, firsts, text_col)).withColumnRenamed("node", "code")
    parts = firsts.select("code", "row").join(linked, "code", "left").select("code", F.coalesce("label", "code").alias("label"), "row")
    return made.select("_h0", "_h1"), checkpointed(parts)
