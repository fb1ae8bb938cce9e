"""Every operator on nulls, empty and long texts, ties, repeated rows, extra columns and empty tables."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from grapevine.llm import (
    byte_bpe,
    hmm,
    language_id,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    vector_graph,
    warc,
)
from grapevine.llm.rows import remainder
from grapevine.session import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, score double, row_id long, component_id long, bin int"
PROSE = "the cat sat on the mat and looked at the moon over the hill "
ROWS = [
    (1, PROSE * 3, "en", "a"),
    (2, PROSE * 3, "en", "a"),
    (2, PROSE * 3, "en", "a"),
    (3, None, "en", None),
    (4, "", None, "a"),
    (5, " \n\t ", "en", "a"),
    (None, PROSE * 2 + "der hund und die katze", None, None),
    (6, "word", "de", "b"),
    (7, "der hund und die katze sind im haus " * 4000, "de", "b"),
    (8, "x" * 20_000, "en", "b"),
    (9, "é漢字🙂 ß", "de", "b"),
]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0.5, 1, 2, 3) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1), (2, 1), (6, 0), (7, 1), (8, 0), (9, None), (None, 1), (4, 0), (4, 1)], "doc_id long, quality int"
    )


def _learn(divisor, out):
    return remainder("doc_id", divisor) != out


OPERATORS = {
    "hmm": lambda d, w, _: hmm.scored(d, remainder("doc_id", 7) == 2, w),
    "packing": lambda d, w, _: packing.packed(d, TOKENIZER, w),
    "sharding": lambda d, w, _: sharding.sharded(d, w),
    "rules": lambda d, w, _: quality_rules.quality_rules(d, w),
    "rules kept": lambda d, w, _: quality_rules.drop_rejected(d, w),
    "classifier": lambda d, _, known: quality_classifier.scored(
        d.select("doc_id", "text"), quality_classifier.fit(d, known, _learn(4, 2))
    ),
    "classifier kept": lambda d, _, known: quality_classifier.accepted(
        d, quality_classifier.fit(d, known, _learn(4, 2)), 0.0
    ),
    "near duplicates": lambda d, w, _: near_dedup.near_duplicates(d, w),
    "near duplicates kept": lambda d, w, _: near_dedup.drop_duplicates(d, w),
    "bytes": lambda d, _, __: byte_bpe.round_trip(d, RANKS, public_tokenizers.PATTERN),
    "language": lambda d, _, __: language_id.labelled(d, language_id.fit(d, _learn(3, 1)), "doc_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, docs, labels, name):
    found = OPERATORS[name](docs, Workspace(spark), labels)
    rows = [r.asDict() for r in found.collect()]
    if name == "packing":
        ends = {r["doc_id"]: r["doc_tokens"] for r in rows}
        assert ends[3] == ends[4] == ends[5] == 1
        assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
        assert len([r for r in rows if r["start"] == 0]) == len(ROWS)
    elif name.endswith("kept"):
        assert found.columns == docs.columns
        expected = {"rules kept": None, "classifier kept": len(ROWS), "near duplicates kept": 9}[name]
        assert expected is None or len(rows) == expected
    else:
        assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows}
    if name == "hmm":
        assert by_id[3]["n_tokens"] == by_id[4]["n_tokens"] == by_id[5]["n_tokens"] == 1
        assert all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    elif name == "sharding":
        assert by_id[3]["size"] == by_id[4]["size"] == 1 and by_id[3]["text_crc32"] == 0
        for shard in range(sharding.SHARDS):
            slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
            assert slots == list(range(len(slots)))
    elif name == "rules":
        assert by_id[3]["base_failed"] and not by_id[3]["kept"] and by_id[3]["n_words"] == 0
    elif name == "near duplicates":
        assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
        assert sum(r["kept"] for r in rows if r["doc_id"] in (1, 2)) == 1
        assert by_id[3]["n_shingles"] == 0 and by_id[3]["component_id"] == 3 and by_id[6]["n_shingles"] == 1
        assert by_id[4]["component_id"] == 4
    elif name == "bytes":
        assert by_id[3]["n_tokens"] == 0 and by_id[3]["ids_sha256"] == by_id[4]["ids_sha256"]
    elif name == "language":
        assert by_id[3]["lang_pred"] == by_id[5]["lang_pred"] == "und" and by_id[3]["score"] == 0
        assert by_id[7]["lang_pred"] == "de"
    elif name == "classifier":
        assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, docs, labels, name):
    assert OPERATORS[name](docs.where("false"), Workspace(spark), labels.where("false")).count() == 0


def test_archives(spark):
    long, short = "<p>" + "a" * 2000, "<p>short"
    rows = [(1, "http://a/\r\nX: y", long), (2, None, long), (3, "http://c", long), (4, "u", short), (5, "u", short)]
    rows += [(6, "u", None), (7, "u", ""), (None, "u", long), (8, "é", "é" * 600)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    found = {r.page_id: r for r in warc.archived(pages, Workspace(spark)).collect()}
    assert len(found) == len(rows)
    assert {i for i, r in found.items() if r.record_type == "revisit"} == {1, 2, None}
    assert {found[i].refers_to for i in (1, 2, None)} == {3}
    assert found[6].payload_bytes == found[7].payload_bytes == 0 and found[8].payload_bytes == 1200
    assert found[1].payload_digest == found[3].payload_digest
    assert warc.archived(pages.where("false"), Workspace(spark)).count() == 0


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.99, 0.05], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1)]
    rows += [(6, None, 1), (7, [nan, 1.0], 1), (8, [1.0, 0.0], None), (9, [None, 1.0], 1), (10, [1.0], 1), (11, [], 1)]
    rows += [(None, [2.0, 0.0], 1), (12, [0.0, 1.0], 1), (2, [1.0, 0.0], 1), (13, [float("inf"), 0.0], 1)]
    vectors = spark.createDataFrame(
        [(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, node int"
    )
    found = vector_graph.near_vectors(vectors, Workspace(spark)).collect()
    assert len(found) == len(rows)
    links = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in found}
    assert {(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (None, 4, 1, False)} <= links
    alone = {4, 5, 6, 7, 8, 9, 10, 11, 12, 13}
    assert {(i, 0, i, True) for i in alone} <= links
    assert vector_graph.near_vectors(vectors.where("false"), Workspace(spark)).count() == 0


def test_hot_rows_of_vectors_and_texts(spark):
    """A third of the rows are one text; all still come out, and near balance holds."""
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit(PROSE)).otherwise(F.concat(F.lit("w"), F.col("id"), F.lit(" x " * 7))).alias("text"),
    )
    sizes = [r for r in sharding.sharded(rows, Workspace(spark)).groupBy("shard").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and sum(r.n for r in sizes) == 3000
    assert max(r["bytes"] for r in sizes) < 1.05 * min(r["bytes"] for r in sizes)
    found = near_dedup.near_duplicates(rows, Workspace(spark))
    assert found.where("component_id = 0").count() == 1000
