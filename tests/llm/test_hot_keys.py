"""Operators give the same rows where every key is dealt over tasks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from grapevine.llm import components, hmm, near_dedup, vector_graph, warc
from grapevine.llm.rows import remainder
from grapevine.operators import skew
from grapevine.session import Workspace

TEXT = "the quick brown fox jumps over the lazy dog while seven sailors sing old songs near the harbour wall "


@pytest.fixture
def both_ways(request, spark, monkeypatch):
    """Runs a job with plain joins, then with every key dealt out."""

    def run(job):
        plain = job()
        request.getfixturevalue("always_skewed")
        dealt, calls = [], skew._with_salts
        monkeypatch.setattr(skew, "_with_salts", lambda *a: dealt.append(a[1]) or calls(*a))
        return plain, job(), dealt

    return run


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stars_around_hubs(spark, both_ways):
    """Two hubs, the least and the largest node of their stars, a chain, and a pair."""
    pairs = [(0, i) for i in range(1, 60)] + [(i, 500) for i in range(100, 150)]
    pairs += [(i, i + 1) for i in range(200, 212)] + [(900, 901)]
    links = spark.createDataFrame(pairs, "u long, v long")
    plain, dealt, keys = both_ways(lambda: rows_of(components.components(links, Workspace(spark))))
    expected = [(i, 0) for i in range(1, 60)] + [(i, 100) for i in [*range(101, 150), 500]]
    expected += [(i, 200) for i in range(201, 213)] + [(901, 900)]
    assert plain == dealt == sorted(expected, key=repr)
    assert ["u"] in keys


def test_near_duplicates_of_a_large_component(spark, both_ways):
    words = TEXT.split() * 4
    rows = [(i, " ".join([*words, f"end{i % 7}"])) for i in range(40)]
    rows += [(100 + i, f"another text {i} " + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(8)]
    docs = spark.createDataFrame([*rows, (200, None), (201, "")], "doc_id long, text string")
    plain, dealt, keys = both_ways(lambda: rows_of(near_dedup.near_duplicates(docs, Workspace(spark))))
    assert plain == dealt and len(plain) == docs.count()
    assert sum(component == 0 for _, _, component, _ in plain) == 40
    assert ["root"] in keys and ["u"] in keys and ["v"] in keys


def test_vectors_with_a_hot_embedding(spark, both_ways):
    rng = np.random.default_rng(2)
    one = rng.normal(size=8)
    vectors = [(i, 1, (one if i < 20 else one + rng.normal(size=8) * 0.01).tolist()) for i in range(30)]
    vectors += [(100 + i, i % 2, rng.normal(size=8).tolist()) for i in range(10)] + [(200, None, one.tolist()), (201, 1, None)]
    table = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>")
    plain, dealt, keys = both_ways(lambda: rows_of(vector_graph.near_vectors(table, Workspace(spark)).drop("recall")))
    assert plain == dealt and len(plain) == len(vectors)
    assert sum(component == 0 for _, _, component, _ in plain) == 30
    assert ["label", "embedding"] in keys and ["root"] in keys


def test_words_that_stand_in_very_many_blocks(spark, both_ways):
    entries = [(b, p, b * 31 % 5 if p else 9, 3, b % 3) for b in range(50) for p in range(4)]
    table = spark.createDataFrame(entries, "block long, place int, hash long, class int, times int")
    table = table.withColumn("class", (F.col("hash") + 1).cast("int"))

    def job():
        return rows_of(hmm._counted(table, 50, Workspace(spark)))

    plain, dealt, keys = both_ways(job)
    assert plain == dealt and len(plain) == 200
    assert sum(once for *_, once in plain) == 6
    assert ["hash"] in keys


def test_scores_do_not_depend_on_how_counts_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(i, TEXT * (i % 3) + f"word{i}") for i in range(30)], "doc_id long, text string")
    held_out = remainder("doc_id", 7) == 2
    job = lambda: rows_of(hmm.scored(docs, held_out, Workspace(spark)))
    plain = job()
    monkeypatch.setattr(skew, "HOT_ROWS", 0)
    assert [r[:5] for r in job()] == [r[:5] for r in plain]
    assert np.allclose([r[5:] for r in job()], [r[5:] for r in plain])


@pytest.mark.parametrize("hot_rows", [1, 3, 10**6])
def test_pages_with_a_payload_of_very_many(spark, monkeypatch, hot_rows):
    """Payloads of five, two and one pages, one of pages without id alone, and small ones."""
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    big = {name: name * 1200 for name in "abcd"}
    rows = [(i, "u", big["a"]) for i in range(5)] + [(i, "u", big["b"]) for i in (10, 11)] + [(20, None, big["c"])]
    rows += [(None, "u", big["d"])] * 4 + [(i, "u", "short") for i in (30, 31)] + [(40, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.with_responses(warc.digested(pages))
    assert found.columns == warc.digested(pages).columns + ["refers_to"]
    expected = [(i, 4 if i < 4 else 11 if i == 10 else None) for i in (0, 1, 2, 3, 4, 10, 11, 20, 30, 31, 40)]
    assert rows_of(found.select("page_id", "refers_to")) == sorted([*expected, *[(None, None)] * 4], key=repr)
