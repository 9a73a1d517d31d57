"""The near-duplicate stage of the corpus pipeline against brute-force Jaccard."""

import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from tickloom.llm import nearcopies


def brute_groups(texts):
    """Position -> least position joined to it by chains of Jaccard 0.8 or more on five-word shingles."""
    sets = []
    for text in texts:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return root


def edited(seed=3, bases=25, copies=8):
    """Texts and copies with one to eight words in a hundred changed."""
    rnd = random.Random(seed)
    out = []
    for _ in range(bases):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(20, 400))]
        out.append(" ".join(base))
        for _ in range(copies):
            changed = list(base)
            for _ in range(max(1, len(base) * rnd.randint(0, 8) // 100)):
                changed[rnd.randrange(len(base))] = f"x{rnd.randrange(3000)}"
            out.append(" ".join(changed))
    return out


def test_stage_keeps_one_of_each_jaccard_group(spark, docs_of, sf_dir):
    texts = edited()
    want = brute_groups(texts)
    got = corpus_pipeline.near_duplicates(spark, docs_of(list(enumerate(texts))), sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(want))
    assert 25 < len(set(want)) < len(texts)


def test_stage_of_all_documents(spark, real, sf_dir):
    ids, docs = sorted(real), spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {ids[r] for r in brute_groups([real[i] for i in ids])}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()} == want


def test_masks_bring_pairs_at_the_least_likeness_together():
    rnd, n = random.Random(5), 1500
    masks = [np.array(m, np.int64).view(np.uint64) for m in nearcopies.drawn_masks(9, 1)]
    found = 0
    for _ in range(n):
        common, left, right = rnd.sample(range(1 << 62), 80), rnd.sample(range(1 << 62), 10), rnd.sample(range(1 << 62), 10)
        a, b = (nearcopies.fingerprint(np.array(common + x, np.uint64)) for x in (left, right))
        found += np.bitwise_count(a ^ b).sum() <= nearcopies.RADIUS and any(not ((a ^ b) & m).any() for m in masks)
    assert found >= (nearcopies.RECALL - 0.03) * n


def test_large_families_are_dealt_to_tasks_and_lose_no_link(spark, docs_of, sf_dir, monkeypatch):
    for name, value in (("FAMILY", 4), ("LEADERS", 2), ("NODE_LIMIT", 6)):
        monkeypatch.setattr(nearcopies, name, value)
    texts = edited(11, 4, 40)
    want = brute_groups(texts)
    got = corpus_pipeline.near_duplicates(spark, docs_of(list(enumerate(texts))), sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(want))


def test_rows_are_judged_by_their_group_not_by_their_id(spark, docs_of, sf_dir):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, d), (3, e), (3, e), (None, e)]
    got = corpus_pipeline.near_duplicates(spark, docs_of(rows), sf_dir).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("None", a), ("None", b), ("1", c), ("1", d), ("3", e)])
