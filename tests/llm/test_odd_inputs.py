"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshwork.llm import op1_packing, op2_jaccard, op3_quality, op4_neighbours, op5_decontaminate, op6_secrets, op7_suffixes, op8_urls, op9_lines, op10_language

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _i long, _h string, row int, doc string, k int, path string"
LONG = " ".join(f"word{n % 7919}{n % 31}" for n in range(60_000))
TEXTS = [
    (1, None), (2, ""), (3, "   \n\t\n"), (None, "a text without an id that has some words of its own in it"), (None, None),
    (4, "the same text comes twice here with the same id, and once with another"), (4, "the same text comes twice here with the same id, and once with another"),
    (5, "the same text comes twice here with the same id, and once with another"), (6, LONG), (7, "x"), (8, "ünïcödé wörds 中文字符 and an emoji 😀 at the end"), (9, "!!! ### $$$ 123"),
]


def rows(texts):
    return [(i, t, "en" if i and i % 2 else None, "s", None if t is None else len(t), 7, "h", 0, "d", 1, "p") for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(TEXTS), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (4, 0, 0), (7, 0, 0), (9, None, 0), (None, 1, 0), (8, 1, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "same text comes twice here with the same id, and ONCE"), (5, "same text comes twice here with the same id, and ONCE"), (None, "123")], "item_id long, text string")


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_packing(odd, none):
    got = op1_packing.pack_documents(odd).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(r["length"] for r in got if r["doc_id"] in (1, 2)) == [1, 1]
    assert sum(r["doc_id"] == 4 for r in got) == 2
    long = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 6)
    assert len(long) > 1 and all(n == 2048 for _, _, n in long[1:]) and all(a[1] + a[2] == b[1] for a, b in zip(long, long[1:], strict=False))
    assert op1_packing.pack_documents(none).count() == 0


def test_jaccard(odd, none):
    got = {(r["doc_id"], r["n_shingles"]): r for r in op2_jaccard.groups(odd).collect()}
    assert op2_jaccard.groups(odd).count() == len(TEXTS)
    assert got[(5, 10)]["class_id"] == 4 and got[(5, 10)]["n_copies"] == 3 and got[(1, 0)]["class_id"] == 1 and got[(1, 0)]["n_links"] == 0
    kept = op2_jaccard.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 7, 8, 9]
    assert op2_jaccard.groups(none).count() == 0 and op2_jaccard.keep_one(none).count() == 0


def test_quality(odd, none, labels):
    got = op3_quality.score(odd, op3_quality.fit(odd, labels)).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert op3_quality.keep(odd, labels).columns == odd.columns
    assert {r["score"] for r in op3_quality.score(odd, op3_quality.fit(odd, labels.limit(0))).collect()} == {1.0}
    assert op3_quality.score(none, op3_quality.fit(none, labels)).count() == 0


def test_neighbours(spark):
    v = [1.0, 2.0]
    data = [(0, v, 1), (1, v, 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (20, [2.0, 1.0], 1), (20, [2.0, 1.0], 1), (None, v, 1), (7, [1.0], 1), (8, v, 1)]
    got = op4_neighbours.search(op4_neighbours.usable(spark.createDataFrame(data, "vec_id long, embedding array<float>, rank int")), F.col("id") % 20 == 0, k=2)
    # rows that repeat an id are rows of their own: queries, and candidates of each other
    assert collected(got) == [(0, 1, 1, 5.0), (0, 2, 8, 5.0), *[(20, 1, 20, 5.0)] * 2, *[(20, 2, 0, 4.0)] * 2]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op4_neighbours.search(op4_neighbours.usable(empty), F.col("id") % 20 == 0).count() == 0


def test_decontamination(spark, odd, none, items):
    got = {(r["doc_id"], r["n_words"]): r for r in op5_decontaminate.contamination(odd, items).collect()}
    assert got[(1, 0)]["n_hit"] == 0 and got[(7, 1)]["item_ids"] == ["3"] and got[(9, 1)]["n_hit"] == 1 and got[(9, 1)]["item_ids"] == []
    assert got[(5, 14)]["item_ids"] == ["4", "5"] and got[(5, 14)]["n_hit"] == 11
    kept = op5_decontaminate.decontaminate(odd, items)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "6", "8", "None", "None"]
    assert op5_decontaminate.contamination(odd, items.limit(0)).where("n_hit > 0").count() == 0
    assert op5_decontaminate.contamination(none, items).count() == 0


def test_decontamination_at_any_size(odd, items, monkeypatch):
    want = collected(op5_decontaminate.contamination(odd, items).select("doc_id", "n_words", "n_hit", "item_ids"))
    monkeypatch.setattr(op5_decontaminate, "BROADCAST_BYTES", -1)
    assert collected(op5_decontaminate.contamination(odd, items).select("doc_id", "n_words", "n_hit", "item_ids")) == want


def test_secrets(odd, none):
    got = op6_secrets.scan(odd).collect()
    assert len(got) == len(TEXTS) and all(r["spans"] == "" for r in got if r["doc_id"] in (1, 2, 3))
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert op6_secrets.scan(none).count() == 0


def test_suffixes(odd, none):
    got = {}
    for r in op7_suffixes.remove(odd).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"]))
    assert got[1] == [(0, 0)] and len(got[4]) == 2 and got[6][0][0] == len(LONG)
    assert op7_suffixes.remove(none).count() == 0


def test_suffixes_of_repeated_rows(spark):
    text = "".join(chr(97 + k * k % 23) + str(k) for k in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text[:450])], "doc_id long, text string")
    assert collected(op7_suffixes.remove(docs).select("doc_id", "n_removed")) == [(1, len(text)), (1, len(text)), (2, 450)]


def test_urls(spark):
    long = "https://" + "ab-" * 20_000 + "/" + "x/" * 30_000
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x#y", "x://h?q/en/", "https://example.net/de/81", "https://sub.example.net/de/9", "https://org/es/", "https://borg/es/", long]
    names = "page_id long, url string, host string, path string, rule string, score string, verdict string, b string, h string, kept string"
    pages = spark.createDataFrame([(k, u, *["h"] * 8) for k, u in enumerate(urls)], names)
    zero = [0.0] * (op8_urls.BUCKETS + 1)
    got = {r["page_id"]: r for r in op8_urls.judge(pages, zero).collect()}
    assert [(got[k]["host"], got[k]["path"]) for k in range(6)] == [("", "")] * 4 + [("a.example.com", "/en/7"), ("h", "")]
    assert [got[k]["rule"] for k in range(4, 10)] == ["example.com/en/7", None, "example.net/de/8", "net/de/", "org/es/", None]
    assert got[4]["verdict"] == "allow" and got[6]["verdict"] == "block" and got[0]["score"] == 0.5
    assert len(got[10]["host"]) == 60_000 and len(got[10]["path"]) == 60_001 and got[10]["verdict"] == "allow"
    assert op8_urls.judge(pages.limit(0), zero).count() == 0
    assert collected(op8_urls.judge(pages.union(pages), zero)) == sorted(2 * collected(op8_urls.judge(pages, zero)), key=repr)
    assert op8_urls.judge(pages, zero, keep=("b", "kept")).columns == ["b", "kept", "host", "path", "rule", "score", "verdict"]
    with pytest.raises(ValueError, match="host"):
        op8_urls.judge(pages, zero, keep=("host",))
    assert op8_urls.fit(spark.createDataFrame([(None, 1), ("http://x", None)], "url string, label int")) == zero
    with pytest.raises(ValueError, match="labelled"):
        op8_urls.fit_rows([("http://x/", 1)] * (op8_urls.MAX_LABELLED + 1))


def test_lines(odd, none):
    got = op9_lines.dedup(odd)
    assert got.columns == odd.columns and sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "2", "3", "4", "4", "6", "7", "8", "9", "None", "None"]
    assert op9_lines.dedup(none).count() == 0


def test_language(odd, none):
    model = op10_language.fit(odd)
    got = {r["doc_id"]: r for r in op10_language.identify(odd, model).collect()}
    assert op10_language.identify(odd, model).count() == len(TEXTS)
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1, 2, 3, 9)) and got[7]["lang_pred"] == "en"
    empty = op10_language.fit(none)
    assert {r["lang_pred"] for r in op10_language.identify(odd, empty).collect()} == {"und"} and op10_language.identify(none, empty).count() == 0


def test_pipeline_stages(spark, odd, labels, items, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, str(tmp_path))
        assert name == "packing" or got.columns == odd.columns
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


@pytest.mark.parametrize("stage", ["quality", "lines", "near_duplicates", "decontamination"])
def test_stages_at_any_size(odd, labels, items, monkeypatch, stage):
    """The same rows whether decisions are broadcast or texts are shuffled."""
    from meshwork.llm import common

    run = {"quality": lambda: op3_quality.keep(odd, labels), "lines": lambda: op9_lines.dedup(odd), "near_duplicates": lambda: op2_jaccard.keep_one(odd), "decontamination": lambda: op5_decontaminate.decontaminate(odd, items)}[stage]
    want = collected(run())
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert collected(run()) == want
