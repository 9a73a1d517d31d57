"""The corpus pipeline, stage by stage against what each stage's operator says of its input."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tickloom.llm import bytebpe, simhash

from .test_native import base_of
from .test_near_duplicates import brute_groups
from .test_text import brute_leaks


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Name -> (input rows, output rows)."""
    root = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        after = spark.read.parquet(f"{root}/{name}")
        out[name] = (docs.collect(), after.collect())
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert before[0].__fields__ == after[0].__fields__, name


def test_language_keeps_all_with_letters(stages):
    before, after = stages["language"]
    letters = {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in after} == letters


def test_language_stage_rejects_and_relabels(spark, docs_of, sf_dir):
    rnd = random.Random(3)
    pools = {"fr": "le chat et la souris vont au marché pour manger une pomme".split(), "de": "der hund und die katze gehen zum markt um brot zu kaufen".split()}
    say = lambda k, n=40: " ".join(rnd.choice(pools[k]) for _ in range(n))
    rows = [(i, say(k), k) for i, k in enumerate(["fr", "de"] * 40)]
    rows += [(200, "Xq7Zk9Wv" * 40, "fr"), (201, "1234 !!", "fr"), (202, None, "fr"), (203, say("fr"), None), (204, say("fr"), "de"), (205, say("fr"), "fr"), (205, say("de"), "de")]
    got = corpus_pipeline.language(spark, docs_of(rows), sf_dir).collect()
    langs = sorted((r["doc_id"], r["lang"]) for r in got if r["doc_id"] >= 200)
    assert langs == [(203, "fr"), (204, "fr"), (205, "de"), (205, "fr")] and len(got) == 84
    assert corpus_pipeline.language(spark, docs_of(rows[:20]).withColumn("lang", F.lit(None).cast("string")), sf_dir).count() == 20


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    rows = sorted(before, key=lambda r: r["doc_id"])
    want = {rows[k]["doc_id"] for k in brute_groups([r["text"] for r in rows])}
    assert {r["doc_id"] for r in after} == want and len(after) == len(want)


def test_leaks_go(spark, sf_dir, stages):
    before, after = stages["decontamination"]
    items = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    leaked = {d for d, _ in brute_leaks({r["doc_id"]: r["text"] for r in before}, items)}
    assert leaked and {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - leaked


def test_secrets_are_masked(stages):
    before, after = stages["secret_scans"]
    text = {r["doc_id"]: r["text"] for r in after}
    assert set(text) == {r["doc_id"] for r in before}
    for r in before:
        spans = base_of(r["text"])
        assert not base_of(text[r["doc_id"]])
        if not spans and "<SECRET>" not in text[r["doc_id"]]:
            assert text[r["doc_id"]] == r["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in after if "<SECRET>" in r["text"])


def test_ids_round_trip(stages):
    before, after = stages["byte_bpe"]
    library = bytebpe.tokenizer(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in before}
    assert len(after) == len(before) and all(r["round_trip"] for r in after)
    assert all(r["n_tokens"] == len(library.encode_ordinary(texts[r["doc_id"]])) for r in after)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = __spark_entry__.queries()["pipeline"](spark, sf_dir)
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in got.collect()) == sorted((r["doc_id"], bytes(r["ids"])) for r in stages["byte_bpe"][1])


def test_near_duplicate_stage_of_odd_rows(spark, odd, empty, sf_dir):
    got = corpus_pipeline.near_duplicates(spark, odd, sf_dir).collect()
    ids = sorted(str(r["doc_id"]) for r in got)
    parts = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert ids == sorted({str(p) for p in parts.values()})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []


CLASHING = ("_id", "spans", "base", "ids", "leaks", "score", "code", "row", "_h0", "_h1", "known", "lang_pred", "hit", "kept")


def test_every_stage_takes_odd_rows(spark, odd, sf_dir):
    """Columns of names that stages use themselves, and a map, come out as they went in."""
    docs = odd.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in CLASHING})
    docs = docs.withColumn("extra", F.create_map(F.lit("k"), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        for r in after.collect():
            doc_id = "-" if r["doc_id"] is None else str(r["doc_id"])
            assert all(r[n] == n + doc_id for n in CLASHING) and r["extra"] == {"k": r["doc_id"]}, (name, r)
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0
