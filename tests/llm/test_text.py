"""Toxicity, byte BPE, language ID, token counts, SimHash and decontamination."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import bytebpe, common, decontam, langid, simhash, tokencount, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def random_texts(n, alphabet, length, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, length))) for _ in range(n)]


# byte BPE


def test_tree_reduction_equals_the_library():
    library = bytebpe.tokenizer(RANKS, public_tokenizers.PATTERN)
    for size in (1, 4, 16):
        for text in random_texts(1500, "ab 'sret\n\t  é1,.　\x1c\x85 Ａ日", 60, size):
            ids = bytebpe.encode_text(text, library.encode_ordinary, size)
            assert ids == library.encode_ordinary(text)
            assert bytebpe.decode_ids(ids, library.decode_bytes, size) == text.encode()


def test_join_is_associative():
    library = bytebpe.tokenizer(RANKS, public_tokenizers.PATTERN).encode_ordinary
    for text in random_texts(300, "ab 's\n1é", 60, 9):
        a, b, c = (bytebpe.leaf(text[i * 20 : i * 20 + 20], library) for i in range(3))
        left, right = bytebpe.join(bytebpe.join(a, b, library), c, library), bytebpe.join(a, bytebpe.join(b, c, library), library)
        whole = lambda s: library(s.head) + (s.ids or []) + library(s.tail)
        assert whole(left) == whole(right) == library(text[:60])


class Watched:
    """A library that notes the longest text it was asked for."""

    def __init__(self, library):
        self.library, self.longest = library, 0
        self.decode_bytes = library.decode_bytes

    def encode_ordinary(self, text):
        self.longest = max(self.longest, len(text))
        return self.library.encode_ordinary(text)

    def _encode_single_piece(self, data):
        self.longest = max(self.longest, len(data))
        return self.library._encode_single_piece(data)


def long_texts():
    rnd = random.Random(3)
    pick = lambda pool, n: "".join(rnd.choices(pool, k=n))
    chinese, base64 = [chr(c) for c in range(0x4E00, 0x4F00)], "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    return {"chinese": pick(chinese, 300_000), "base64": pick(base64, 1_000_000), "x": "x" * 100_000, "spaces": "a" + " " * 50_000 + "b", "digits": pick("0123456789", 100_000), "mixed": pick(["ab", " ", "\n", "'s", "ſ", "é", "日本", "12345"], 20_000) + "y" * 40_000 + " z"}


@pytest.mark.parametrize("name", ["chinese", "base64", "x", "spaces", "digits", "mixed"])
def test_long_texts_without_white_space_are_reduced(name):
    library, text = bytebpe.tokenizer(RANKS, public_tokenizers.PATTERN), long_texts()[name]
    watched = Watched(library)
    ids = bytebpe.encode_text(text, bytebpe.Coder(watched, public_tokenizers.PATTERN))
    if name not in ("x", "spaces"):  # the library's own time grows with the square of a run
        assert ids == library.encode_ordinary(text)
    assert library.decode(ids) == text
    assert watched.longest <= 6 * bytebpe.LEAF


def test_matches_are_reduced_like_the_library():
    library = bytebpe.tokenizer(RANKS, public_tokenizers.PATTERN)
    for size in (1, 3, 8):
        code = bytebpe.Coder(library, public_tokenizers.PATTERN, size)
        for text in random_texts(1500, "abesrtiné日x", 60, size) + ["x" * n for n in range(1, 300, 7)] + random_texts(300, "ab 'sſT\n\t 1,.\x1c\x85", 60, size):
            assert code(text) == library.encode_ordinary(text), (text, size)


def test_bpe_of_all_documents(spark, sf_dir, real):
    library = bytebpe.tokenizer(RANKS, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in bytebpe.op2_byte_bpe(spark, sf_dir).collect()}
    assert sorted(got) == sorted(real)
    for i, text in real.items():
        ids, r = library.encode_ordinary(text or ""), got[i]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_of_odd_rows(odd, empty):
    rows = bytebpe.decoded(bytebpe.encoded(odd.withColumn("ids", F.lit(1)), RANKS), RANKS).select("text", "decoded").collect()
    assert [bytes(r["decoded"]) for r in rows] == [(r["text"] or "").encode() for r in rows]
    assert bytebpe.encoded(empty, RANKS).collect() == []


# token counts


def test_transducer_equals_the_library():
    machine, library = tokencount.compiled(PIECES)
    texts = random_texts(1500, "ab  'sretion\n\té1,.　日本ß▁\x00", 50) + [" " * k + "a" + " " * k for k in range(40)] + ["<s> </s>", "x" * 5000]
    for text in texts:
        for chunk in (3, 7, 4096):
            got = tokencount.count_tokens(library.normalize(text), machine, chunk) if text else 0
            assert got == len(library.encode(text)), (text, chunk)


def test_chunk_maps_compose_in_any_grouping():
    machine, library = tokencount.compiled(PIECES)
    for text in random_texts(200, "ab ret\né", 60, 4):
        text = library.normalize(text)
        a, b, c = (tokencount.chunk_map(text[i * 20 : i * 20 + 21 if i == 2 else i * 20 + 20], machine) for i in range(3))
        total = lambda m: m.count + machine.run(machine.start, m.head)[1]
        assert total(a.then(b, machine).then(c, machine)) == total(a.then(b.then(c, machine), machine))


def test_counts_of_all_documents(spark, sf_dir, real):
    _, library = tokencount.compiled(PIECES)
    got = {r["doc_id"]: r for r in tokencount.op6_token_counts(spark, sf_dir).collect()}
    assert sorted(got) == sorted(real)
    for i, text in real.items():
        n = len(library.encode(text or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 4096)


def test_forgetting_states_changes_nothing():
    machine, library = tokencount.compiled(PIECES)
    text = library.normalize("some words, then others")
    before = tokencount.count_tokens(text, machine)
    machine.forget()
    assert tokencount.count_tokens(text, machine) == before


def test_counts_of_odd_rows(odd, empty):
    _, library = tokencount.compiled(PIECES)
    for r in tokencount.counted(odd.withColumn("n_tokens", F.lit("x")), PIECES).collect():
        assert r["n_tokens"] == len(library.encode(r["text"] or ""))
    assert tokencount.counted(empty, PIECES).collect() == []


# SimHash


def brute_code(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_parts(codes, radius=4):
    parent = {i: i for i in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(codes)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(codes[i] ^ codes[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_of_all_documents(spark, sf_dir, real):
    got = {r["doc_id"]: r for r in simhash.op9_simhash(spark, sf_dir).collect()}
    codes = {i: brute_code(t) for i, t in real.items()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == codes
    assert {i: r["component_id"] for i, r in got.items()} == brute_parts(codes)


def planted_codes(n, seed):
    """Clusters, chains and strangers, so that links cross every block."""
    rnd = random.Random(seed)
    out = []
    while len(out) < n:
        code = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 3, 12])):
            out.append(code)
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                code ^= 1 << b
    return list(dict.fromkeys(out))[:n]


@pytest.mark.parametrize("node_limit", [20_000, 3])
def test_links_lose_no_pair(spark, node_limit):
    codes = planted_codes(500, node_limit)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    frame = spark.createDataFrame([(c,) for c in signed], "code long")
    labels = {r["node"]: r["label"] for r in simhash.components(simhash.links(frame, 4, node_limit)).collect()}
    want = brute_parts(dict(enumerate(codes)))
    groups = {}
    for i, part in want.items():
        groups.setdefault(part, set()).add(signed[i])
    got = {}
    for c in signed:
        got.setdefault(labels.get(c, c), set()).add(c)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_tree_search_equals_all_pairs():
    codes = np.sort(np.array(planted_codes(3000, 8), np.uint64))
    got = {(int(i), int(j)) for a, b in simhash._near(codes.reshape(-1, 1), 4) for i, j in zip(a, b, strict=True)}
    want = {(i, int(j) + i + 1) for i in range(len(codes)) for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= 4)}
    assert got == want


@pytest.mark.parametrize("blocks", range(5, 9))
def test_masks_share_a_choice_of_blocks(blocks):
    rnd = random.Random(blocks)
    chosen = simhash.masks(blocks, 4, list(range(64)))
    for _ in range(300):
        difference = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(not difference & m & ((1 << 64) - 1) for (m,) in chosen)


def test_hot_labels_and_hubs_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 3)
    rnd = random.Random(4)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(70)]
    parent = list(range(300))
    for _ in range(300):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["node"]: r["label"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: parent[n] for e in edges if e[0] != e[1] for n in e}


def test_one_large_group_of_near_copies(spark, docs_of, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 3)
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(900)}" for _ in range(300)]
    texts = [" ".join(base)] * 40 + [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(0, 300, 3)] + [f"other text number {k}" for k in range(40)]
    want = brute_parts({i: brute_code(t) for i, t in enumerate(texts)})
    got = simhash.near_duplicates(docs_of(list(enumerate(texts))), node_limit=10).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_long_chain_ends(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r["label"] for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.limit(0)).collect() == []


def test_simhash_of_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    parts = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == 12 and parts[1] == parts[2] == parts[3] == 1 and parts[8] == parts[9] == 8
    assert simhash.near_duplicates(empty).collect() == []


# language ID


def test_language_of_held_out_documents(spark, sf_dir, real):
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    got = langid.op5_language_id(spark, sf_dir).collect()
    assert len(got) == len(real) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97


def test_more_languages_than_bits(docs_of):
    rnd = random.Random(2)
    syllables = {f"l{k:02d}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(12)] for k in range(70)}
    say = lambda k: " ".join("".join(rnd.choices(syllables[k], k=2)) for _ in range(60))
    model = langid.train(docs_of([(i, say(k), k) for i, k in enumerate(list(syllables) * 4)]))
    assert len(model.slices) == 2
    names = list(syllables)
    assert np.mean([p == k for p, k in zip(model.predict([say(k) for k in names])[0], names, strict=True)]) > 0.95


def test_bloom_filter_equals_exact_sets(docs_of):
    """The languages of every n-gram are those of exact sets, but for false positives, which are as rare as computed."""
    rnd = random.Random(7)
    rows = [(i, " ".join("".join(rnd.choice("aeiou" + k) for _ in range(5)) for _ in range(80)), k) for i, k in enumerate(["rst", "nlm", "pqk"] * 20)]
    model = langid.train(docs_of(rows))
    counts = {k: {} for k in model.languages}
    for _, text, k in rows:
        for g in langid.grams([text])[0].tolist():
            counts[k][g] = counts[k].get(g, 0) + 1
    rates = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    every = sorted({g for c in counts.values() for g in c})
    held = np.bitwise_and.reduce([model.slices[0][w] for w in langid.slots(np.array(every, np.uint64))])
    for k, name in enumerate(model.languages):
        most = {g: max(r.get(g, 0) for r in rates.values()) for g in every}
        want = np.array([counts[name].get(g, 0) >= langid.LEAST_SEEN and rates[name][g] >= langid.LEAST_SHARE * most[g] for g in every])
        has = (held >> np.uint64(k)) & np.uint64(1) == 1
        assert has[want].all() and has[~want].mean() <= model.positives[k] * 3 + 0.01


def test_letters_of_all_planes():
    assert langid.grams([chr(0x323AF), "\U0001e922", "\U00020000x"])[1].tolist() == [1, 1, 3]


def test_filter_holds_every_gram():
    hashes, _ = langid.grams(["some words of a text"])
    assert len(hashes) and all((w >= 0).all() and (w < 1 << langid.SLOTS_LOG2).all() for w in langid.slots(hashes))
    assert langid.grams(["a", "", None, "12 !"])[1].tolist() == [1, 0, 0, 0]


def test_language_of_odd_rows(odd, empty, docs_of):
    model = langid.train(docs_of([(i, "le chat et la souris vont au marché", "fr") for i in range(9)] + [(i + 9, "der hund und die katze gehen zum markt", "de") for i in range(9)] + [(99, None, "fr"), (98, "x", None)]))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd.withColumn("score", F.lit("x")), model).collect()}
    assert all(got[i] == "und" for i in (1, 2, 3, 4)) and all(got[i] in ("fr", "de") for i in (5, 6, 7, 8, 10))
    assert langid.identify(docs_of([(1, "le chat et la souris")]), model).first()["lang_pred"] == "fr"
    assert langid.identify(empty, langid.train(empty)).collect() == []
    assert langid.identify(odd, langid.train(empty)).filter("lang_pred <> 'und'").count() == 0


# decontamination


def brute_leaks(docs, items, settings=decontam.Settings()):
    sets = {i: decontam.shingles(decontam.words(t), settings.shingle) for i, t in items.items()}
    out = set()
    for d, text in docs.items():
        held = decontam.shingles(decontam.words(text), settings.shingle)
        out |= {(d, i) for i, s in sets.items() if s and len(s & held) >= settings.overlap * len(s)}
    return out


def test_leaks_of_all_documents(spark, sf_dir, real):
    items = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = decontam.op10_decontamination(spark, sf_dir).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_leaks(real, items)
    assert all(r["score"] >= 1 - 1e-9 and r["overlap"] >= 0.8 for r in got)


@pytest.mark.parametrize("settings", [decontam.Settings(), decontam.Settings(segment=8, block=2, index_mb=0)])
def test_edited_and_wrapped_passages(spark, docs_of, settings):
    settings = settings if settings.index_mb else decontam.Settings(segment=8, block=2)
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("aeioustrn") for _ in range(rnd.randint(2, 6))) for _ in range(300)]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = {i: " ".join(say(rnd.randint(3, 200))) + "? " + " ".join(say(rnd.randint(1, 9))) + "." for i in range(60)}
    docs = {}
    for d in range(150):
        passage = items[rnd.randrange(60)].split()
        for _ in range(rnd.choice([0, 0, 1, 2, 6])):
            passage[rnd.randrange(len(passage))] = "changed"
        docs[d] = " ".join([*say(rnd.randint(0, 200)), *passage, *say(rnd.randint(0, 200))]) if d % 3 else " ".join(say(300))
    rows = decontam.screened(docs_of(list(docs.items())), spark.createDataFrame(list(items.items()), "item_id long, text string"), settings)
    got = {(r["doc_id"], x["item_id"]) for r in rows.collect() for x in r["leaks"]}
    want = brute_leaks(docs, items)
    assert got == want and len(want) > 40


@pytest.mark.parametrize("parts", [2, 3])
def test_items_interrupted_by_long_text(spark, docs_of, parts):
    say = lambda name, n: [f"{name}{i}" for i in range(n)]
    items = {i: say(f"item{i}x", n) for i, n in enumerate([60, 64, 100, 300])} | {4: ["so", "it", "goes"] * 20 + say("end", 40)}
    docs = {}
    for i, ws in items.items():
        cuts = [ws[p * len(ws) // parts : (p + 1) * len(ws) // parts] for p in range(parts)]
        docs[i] = " ".join(w for p, cut in enumerate(cuts) for w in [*say(f"other{p}x", 130), *cut])
        docs[100 + i] = " ".join([*ws[: len(ws) // 2], *say("other", 300)])  # half of it is no leak
    items = {i: " ".join(ws) for i, ws in items.items()}
    rows = decontam.screened(docs_of(list(docs.items())), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {(r["doc_id"], x["item_id"]) for r in rows.collect() for x in r["leaks"]}
    assert got == brute_leaks(docs, items) >= {(i, i) for i in range(5)}


def test_a_very_long_document_against_many_items():
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("aeioustrn") for _ in range(rnd.randint(2, 7))) for _ in range(3000)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=50))) for i in range(1500)]
    words = rnd.choices(vocabulary, k=1_000_000)
    parts = items[7][1].split()
    words[1000:1025], words[900_000:900_025] = parts[:25], parts[25:]
    (found,) = decontam.Index(items).leaks([" ".join(words)])
    assert [x["item_id"] for x in found] == [7]


def test_passes_over_a_large_benchmark(spark, docs_of, monkeypatch):
    items = {i: f"item number {i} asks what {i * 7} is in words. it is {i}" for i in range(40)}
    docs = docs_of([(i, f"before {items[i]} after") for i in range(40)])
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    one = decontam.screened(docs, table).collect()
    many = decontam.screened(docs, table.withColumn("text", F.concat("text", F.lit(" " * 60_000))), decontam.Settings(index_mb=1)).collect()
    ids = lambda rows: {(r["doc_id"], x["item_id"]) for r in rows for x in r["leaks"]}
    assert ids(one) == ids(many) >= {(i, i) for i in range(40)}


def test_items_inside_unspaced_scripts(spark, docs_of):
    """Items of scripts without spaces, inside longer runs and edited, equal a search by characters."""
    rnd = random.Random(12)
    pools = ["".join(map(chr, range(0x4E00, 0x4E00 + 400))), "".join(map(chr, range(0x3042, 0x3090))), "กขคงจฉชซดตถทนบปผพฟมยรลวสหอ"]
    say = lambda pool, n: "".join(rnd.choice(pool) for _ in range(n))
    items = {i: say(pools[i % 3], 120) + ("。" + say(pools[i % 3], 10) if i % 2 else "") for i in range(12)}
    docs = {}
    for d in range(60):
        pool, item = pools[d % 3], items[rnd.randrange(12)]
        kept = "".join(c for c in item if rnd.random() > 0.001 * (d % 7))
        docs[d] = say(pool, rnd.randint(0, 400)) + (kept if d % 2 else "") + say(pool, 300) + (" latin words here" if d % 5 == 0 else "")
    rows = decontam.screened(docs_of(list(docs.items())), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {(r["doc_id"], leak["item_id"]) for r in rows.collect() for leak in r["leaks"]}
    by_character = lambda t: [c for c in t if c.isalnum()]
    sets = {i: decontam.shingles(by_character(t), 5) for i, t in items.items()}
    want = {(d, i) for d, t in docs.items() if "latin" not in t for i, s in sets.items() if len(s & decontam.shingles(by_character(t), 5)) >= 0.8 * len(s)}
    assert want and {(d, i) for d, i in got if "latin" not in docs[d]} == want
    assert got == brute_leaks(docs, items)


def test_decontamination_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "same text here"), (4, "?!")], "item_id long, text string")
    got = decontam.screened(odd.withColumn("leaks", F.lit(1)), items).collect()
    assert len(got) == 12 and {r["doc_id"] for r in got if r["leaks"]} == {8, 9}
    assert decontam.screened(empty, items).collect() == []
    assert decontam.screened(odd, items.limit(0)).filter("size(leaks) > 0").count() == 0


def test_predictions_equal_those_of_exact_sets(spark, sf_dir):
    """The same decision on exact sets of n-grams: the corrected counts of the filter change no language and hardly a share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    counts = {}
    for i, text, lang in rows:
        if i % 2 and lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(langid.grams([text])[0].tolist())
    totals = {k: sum(c.values()) for k, c in counts.items()}
    rate = {k: {g: n / totals[k] for g, n in c.items()} for k, c in counts.items()}
    most = {}
    for r in rate.values():
        for g, x in r.items():
            most[g] = max(most.get(g, 0), x)
    sets = {k: {g for g, n in c.items() if n >= langid.LEAST_SEEN and rate[k][g] >= langid.LEAST_SHARE * most[g]} for k, c in counts.items()}
    model = langid.train(docs.filter("doc_id % 2 = 1"))
    assert model.languages == sorted(sets)
    got = {r["doc_id"]: r for r in langid.identify(docs.select("doc_id", "text"), model).collect()}
    for i, text, _ in rows:
        every = langid.grams([text])[0].tolist()
        hits = [sum(g in sets[k] for g in every) for k in sorted(sets)]
        if not every:
            assert got[i]["lang_pred"] == "und"
            continue
        order = sorted(hits, reverse=True)
        if order[0] - order[1] > 0.02 * len(every):  # no tie
            assert got[i]["lang_pred"] == sorted(sets)[hits.index(order[0])]
        assert abs(got[i]["known"] - order[0] / len(every)) < 0.03
        assert abs(got[i]["score"] - order[0] / max(1, sum(hits))) < 0.05


def test_dirty_labels_are_bounded(spark, docs_of):
    rows = [(i, f"le chat et la souris numero {i}", f"dirty {i}") for i in range(300)] + [(1000 + i, "le chat et la souris vont au marché", "fr") for i in range(5)] + [(2000 + i, "der hund und die katze gehen zum markt", "de") for i in range(5)]
    model = langid.train(docs_of(rows), most=3)
    assert model.languages == ["de", "dirty 0", "fr"] and len(model.slices) == 1
    got = langid.identify(docs_of([(1, "die katze und der hund"), (2, "la souris et le chat vont")]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "de", 2: "fr"}


# toxicity


def test_toxicity_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest has too few toxic labels
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect()}
    got = toxicity.op1_toxicity(spark, sf_dir).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert np.mean([p for p, y in held if y == 0]) < 0.02


def test_label_model_overrules_wrong_labels():
    rnd = np.random.default_rng(3)
    y = rnd.random(3000) < 0.2
    votes = np.column_stack([np.where(y, rnd.random(3000) < 0.8, rnd.random(3000) < 0.02) for _ in range(6)]).astype(int)
    votes = np.column_stack([votes, votes[:, 0], votes[:, 0]])  # a voter that only repeats another
    wrong = rnd.random(3000) < 0.1
    p = toxicity.label_model(votes, np.where(wrong, ~y, y).astype(int))
    assert np.mean((p > 0.5) == y) > np.mean(~wrong) + 0.01


def plain_label_model(votes, labels, rounds):
    """The same model a number at a time."""
    n, m = len(votes), len(votes[0])
    p = [0.9 if y else 0.05 for y in labels]
    for _ in range(rounds):
        share = [[1 - q for q in p], p]
        rate, given, like = [], [], [[0.0] * m for _ in range(m)]
        for w in share:
            size = sum(w)
            rate.append([(sum(a * v[k] for a, v in zip(w, votes)) + 0.05) / (size + 0.1) for k in range(m)])
            given.append((sum(a for a, y in zip(w, labels) if y) + 0.05) / (size + 0.1))
        for c, w in enumerate(share):
            size = sum(w)
            cov = [[sum(a * (v[j] - rate[c][j]) * (v[k] - rate[c][k]) for a, v in zip(w, votes)) / size for k in range(m)] for j in range(m)]
            sd = [max(1e-9, cov[k][k]) ** 0.5 for k in range(m)]
            for j in range(m):
                for k in range(m):
                    like[j][k] += size / n * min(1.0, max(0.0, cov[j][k] / (sd[j] * sd[k])))
        many = [max(1.0, sum(like[j][k] for j in range(m) if like[j][k] > toxicity.LEAST_CORRELATION)) for k in range(m)]
        prior = min(1 - 1e-4, max(1e-4, sum(p) / n))
        for i, (v, y) in enumerate(zip(votes, labels)):
            total = np.log(prior / (1 - prior)) + np.log(given[1] / given[0] if y else (1 - given[1]) / (1 - given[0]))
            for k in range(m):
                total += (np.log(rate[1][k] / rate[0][k]) if v[k] else toxicity.ABSTENTION * np.log((1 - rate[1][k]) / (1 - rate[0][k]))) / many[k]
            p[i] = 1 / (1 + np.exp(-min(30, max(-30, total))))
    return p


def test_label_model_equals_a_plain_computation():
    rnd = np.random.default_rng(5)
    y = rnd.random(120) < 0.3
    votes = np.column_stack([np.where(y, rnd.random(120) < 0.7, rnd.random(120) < 0.1) for _ in range(4)]).astype(int)
    votes = np.column_stack([votes, votes[:, 1]])
    labels = np.where(rnd.random(120) < 0.1, ~y, y).astype(int)
    for rounds in (1, 2, 7):
        assert toxicity.label_model(votes, labels, rounds) == pytest.approx(plain_label_model(votes.tolist(), labels.tolist(), rounds), abs=1e-6)


def plain_scores(docs, labels, settings=toxicity.Settings()):
    """Scores of op1's query, features counted and chosen in plain Python; the label model and the regression have their own
    tests."""
    train = [(t, labels[i]) for i, t in docs if i in labels and labels[i] in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    seen, n, toxic = {}, len(train), sum(y for _, y in train)
    for text, y in train:
        for f in toxicity.features(text):
            seen.setdefault(f, [0, 0])[y] += 1
    base = min(max(toxic / n, 1e-4), 1 - 1e-4)
    lift = {f: math.log((b + 0.5) / base) - math.log((a + 0.5) / (1 - base)) for f, (a, b) in seen.items() if b >= settings.least_seen}
    worth = sorted((-lift[f] * math.sqrt(seen[f][1]), f) for f in lift if lift[f] > settings.least_lift)
    names = [f for _, f in worth[: settings.features]]

    def row(text):
        words = toxicity.features(text)
        return [float(f in words) for f in names] + [float(v) for v in toxicity.patterns(text, words)] + [math.log1p(sum(words[f] for f in names if f in words))]

    x = np.array([row(t) for t, _ in train])
    votes = np.column_stack([x[:, : min(settings.voters, len(names))], x[:, len(names) : -1]])
    weights = toxicity.logistic(x, toxicity.label_model(votes, np.array([y for _, y in train]), settings.rounds), settings.ridge)
    return {i: 1 / (1 + math.exp(-(float(np.dot(row(t), weights[:-1])) + weights[-1]))) for i, t in docs}


def test_trained_scores_equal_a_plain_training(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    want = plain_scores(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.op1_toxicity(spark, sf_dir).collect()}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-3


def test_toxic_documents_are_found(spark):
    """Recall, false positives and the ROC area on held-out documents of the largest table."""
    sf_dir = "/root/testdata/sf0.1"
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect()}
    rows = [(r["score"], r["predicted"], truth[r["doc_id"]]) for r in toxicity.op1_toxicity(spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = [r for r in rows if r[2] == 1], [r for r in rows if r[2] == 0]
    recall, wrong = sum(r[1] for r in toxic) / len(toxic), sum(r[1] for r in clean) / len(clean)
    order = sorted(clean)
    scores = [r[0] for r in order]
    area = sum(bisect.bisect_left(scores, t[0]) + bisect.bisect_right(scores, t[0]) for t in toxic) / (2 * len(toxic) * len(clean))
    assert len(toxic) > 30 and recall >= 0.7 and wrong <= 0.02 and area >= 0.85


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    for model in (toxicity.train(odd, labels), toxicity.train(empty, labels), toxicity.train(odd, labels.limit(0)), toxicity.train(odd, labels.filter("toxic = 1"))):
        got = toxicity.scored(odd.withColumn("score", F.lit("x")), model).collect()
        assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
        assert toxicity.scored(empty, model).collect() == []
