"""URL filters, the Merkle manifest and lexical search against plain computations."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.llm import lexical, merkle, urlfilter

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


# op11


def plain_verdict(rules, url, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = {}
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h + p), len(h), h, p)
            fits[key] = max(v, fits.get(key, v))
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[2] + best[3], fits[best]


def judge(spark, rules, urls, **more):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    return {r["page_id"]: tuple(r)[1:] for r in urlfilter.judged(pages, urlfilter.rules_of(spark, tuple(rules)), **more).collect()}


ODD_URLS = [None, "", "no scheme", "http://", "HTTP:///en/1", "ftp://EXAMPLE.org/es/", "a://b://c/d", "http://example.org", "http://x.example.org/es/?q#f", "http://badexample.org/es/", "http://é.org/", "http://org/\n", "http://" + "a." * 3000 + "org/" + "p" * 30_000, "http://..org/", "http://org./"]


def test_urls_follow_the_rules(spark):
    want = {i: plain_verdict(urlfilter.RULES, u) for i, u in enumerate(ODD_URLS)}
    assert judge(spark, urlfilter.RULES, ODD_URLS) == want
    assert want[5][2:] == ("example.org/es/", "block") and want[9][2:] == ("org/", "allow") and want[7][2:] == (None, "allow")


def test_nested_rules_in_small_blocks_equal_a_plain_search(spark):
    draw = random.Random(5)
    some = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    rules = [(some("ab.", draw.randint(0, 4)), draw.choice(["", "/", "/a", "/ab", "/a/", "/b", "/ab/a"]), draw.choice(["allow", "block"])) for _ in range(80)]
    urls = ["http://" + some("ab.", draw.randint(0, 6)) + draw.choice(["", "/", "/a", "/ab", "/a/b", "/b/", "/ab/ab", "?/a", "#/b"]) for _ in range(400)]
    urls += urls[:1] * 300  # a pair that a third of the rows share
    got = judge(spark, rules, urls, rows_a_block=9, default="block")
    assert got == {i: plain_verdict(rules, u, "block") for i, u in enumerate(urls)}


def test_rules_that_are_none_or_wrong(spark):
    assert judge(spark, [], ["http://a.org/"])[0] == ("a.org", "/", None, "allow")
    assert judge(spark, urlfilter.RULES, []) == {}
    with pytest.raises(ValueError, match="path"):
        judge(spark, [("a", "no slash", "block")], ["http://a/"])


def test_stack_names_each_rules_parent(spark):
    rules = [("org", "", "allow"), ("org", "/a", "block"), ("org", "/a/b", "allow"), ("b.org", "/", "block"), ("com", "/", "block")]
    known = urlfilter._known(urlfilter.rules_of(spark, tuple(rules)))
    changes = urlfilter.stack_changes(known, rows_a_block=2).orderBy("key").collect()
    # a walk over all edges: beginnings push, ends pop
    stack = []
    for r in changes:
        if bytes(r["key"]).endswith(b"\xff"):
            stack.pop()
        else:
            stack.append(r["top"]["host"] + r["top"]["path"])
        assert (r["top"]["host"] and r["top"]["host"] + r["top"]["path"]) == (stack[-1] if stack else None)


def test_sql_of_urls_manifest_and_search(spark, sf_dir):
    con = duckdb.connect()
    for name in ("pages", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for query, sql in ((urlfilter.op11_url_filters, urlfilter.oracle()), (merkle.op12_merkle, merkle.oracle()), (lexical.op13_lexical, lexical.oracle())):
        got, want = query(spark, sf_dir), con.sql(sql)
        assert got.columns == want.columns
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))


# op12


def told(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return told(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """The root, and each leaf's siblings, level by level."""
    paths, under, now = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(now) > 1:
        above, held = [], []
        for i in range(0, len(now), merkle.RUN):
            run = now[i : i + merkle.RUN]
            for k in range(len(run)):
                for x in under[i + k]:
                    paths[x].append((k, run[:k] + run[k + 1 :]))
            above.append(told(*run))
            held.append([x for u in under[i : i + merkle.RUN] for x in u])
        now, under = above, held
    return now[0], paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    parts, subroots = [], []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        leaves = []
        for r in groups[source]:
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            leaves.append((r[0], plain_leaf(r), plain_leaf((*r[:4], text))))
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        root, paths = plain_tree([x[1] for x in leaves])
        parts.append((leaves, paths))
        subroots.append(root)
    root, up = plain_tree(subroots)
    out = []
    for (leaves, paths), subroot, rest in zip(parts, subroots, up, strict=True):
        for (doc_id, leaf, changed), path in zip(leaves, paths, strict=True):
            node = changed
            for k, others in path + rest:
                node = told(*others[:k], node, *others[k:])
            out.append((doc_id, leaf, subroot, root, told(*(x for _, others in path + rest for x in others)), node, node == root))
    return sorted(out, key=str)


def of_frame(docs, **more):
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = {"text": F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))}
    rows = merkle.verified(merkle.manifest(docs, changed=changed, **more))
    return sorted((tuple(r) for r in rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_manifest_of_all_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*merkle.FIELDS).collect()]
    got = sorted(map(tuple, merkle.op12_merkle(spark, sf_dir).collect()), key=str)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_in_small_blocks_of_odd_rows(spark):
    draw = random.Random(2)
    rows = [(draw.choice([None, 1, 2, i, i, i]), draw.choice([None, "", "a", "a", "a", "a", "é", "z"]), None, i % 5, draw.choice([None, "", "x\ny", str(i)])) for i in range(400)]
    rows += [(7, "a", "e", 1, "same\n")] * 40 + [(1, f"s{i}", None, None, "t\n") for i in range(60)] + [(9, "long", None, 1, "long\n" * 50_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"_g": F.lit(1), "path": F.lit("clash"), "leaf": F.lit("clash")})
    assert of_frame(docs, levels=2, rows_a_block=50) == plain_manifest(rows)


def test_manifest_of_few_rows(spark):
    assert of_frame(spark.createDataFrame([], DOCS)) == []
    rows = [(1, "a", "e", 1, "x\ny")]
    assert of_frame(spark.createDataFrame(rows, DOCS)) == plain_manifest(rows)
    for n in (3, 4, 9, 10, 27, 28, 82):
        rows = [(i, None, "e", 1, "x") for i in range(n)]
        assert of_frame(spark.createDataFrame(rows, DOCS), levels=1) == plain_manifest(rows)


# op13


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_search(docs, items, k):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for at, (i, c, n) in enumerate(counts):
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, at))
        out += [(item, r + 1, x[2] if x[1] else None, -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_search_equals_a_plain_one(spark):
    draw = random.Random(4)
    words = ["The", "the", "x1", "éa", "日本", "n\x7f", "Ünï", *[f"w{i}" for i in range(60)]]
    docs = [(draw.choice([None, i, i, i // 2]), " ".join(draw.choices(words, weights=[20, 20, *[1] * (len(words) - 2)], k=draw.randint(0, 60)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "-- !!"), (403, "long w1 " * 30_000), (5, "same w3"), (5, "same w3")] + [(500 + i, "copy of w5 w6") for i in range(120)]
    items = [(None, "w1 w2"), (1, None), (2, "..."), (3, "The THE the w9 w9"), (4, "w3"), (4, "w5, w6"), (6, "nowhere"), (7, " ".join(words))]
    frame = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, row int, term string")
    asked = spark.createDataFrame([(*i, "c") for i in items], "item_id long, text string, doc_id string")
    for block_bytes in (lexical.BLOCK_BYTES, 4000):  # one block of items, and several
        got = lexical.search(frame, asked, k=20, block_bytes=block_bytes)
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(docs, items, 20)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(none, one).count() == 0
    assert lexical.search(one.toDF("doc_id", "text"), one.limit(0)).count() == 0
