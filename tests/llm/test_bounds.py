"""Bounds on memory and on what meets in a task."""

from __future__ import annotations

import re
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grapevine import session
from grapevine.llm import components, near_dedup, packing, quality_classifier, quality_rules, queries, rows, warc
from grapevine.llm import words as W
from grapevine.llm.rows import with_columns
from grapevine.llm.sketches import COORDINATES, shingles, sketch
from grapevine.session import Workspace


def members(n, copies, seed=4):
    """Nodes of one bucket: their sketches agree nearly everywhere, or (if not ``copies``) in part."""
    rng = np.random.default_rng(seed)
    noise = 0.002 if copies else 0.17

    def sketches(size):
        rows = np.tile(rng.integers(0, 1 << 16, size).astype("<u2"), (n, 1))
        return np.where(rng.random((n, size)) < noise, rng.integers(0, 1 << 16, (n, size)), rows).astype("<u2")

    short, fine = sketches(COORDINATES), sketches(near_dedup.FINE)
    short[:, : near_dedup.BAND] = 7  # all agree in the first band
    return {
        "key": np.zeros(n, np.int64),
        "band": np.zeros(n, np.int32),
        "first": np.zeros(n, np.int32),
        "second": np.ones(n, np.int32),
        "block": rng.integers(0, 2, n).astype(np.int32),
        "node": np.arange(n) * 3 + 5,
        "comp": rng.integers(0, n // 2, n),
        "n_shingles": rng.integers(300, 420, n),
    }, short, fine


def batch_of(columns, short, fine):
    raw = {"sketch": [r.tobytes() for r in short], "fine": [r.tobytes() for r in fine]}
    arrays = [pa.array(v) for v in columns.values()] + [pa.array(v, pa.binary()) for v in raw.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*columns, *raw])


def plain(columns, short, fine, most):
    found, n = {}, len(short)
    for i in range(n):
        for j in range(i + 1, n):
            small, large = sorted((columns["n_shingles"][i], columns["n_shingles"][j]))
            agree = int((fine[i] == fine[j]).sum())
            if (
                columns["comp"][i] != columns["comp"][j]
                and columns["block"][i] != columns["block"][j]
                and 100 * small >= near_dedup.PERCENT * large
                and (short[i] == short[j]).sum() >= near_dedup.ALIKE
                and agree >= near_dedup.FINE_ALIKE
            ):
                found.setdefault(i, []).append((-agree, columns["node"][j], j))
                found.setdefault(j, []).append((-agree, columns["node"][i], i))
    pairs = {(min(i, j), max(i, j)) for i, all_ in found.items() for _, _, j in sorted(all_)[:most]}
    return {(int(columns["node"][i]), int(columns["node"][j])) for i, j in pairs}


@pytest.mark.parametrize("most", [3, None])
@pytest.mark.parametrize("held", [1 << 18, 10])
def test_proposals_are_the_best_pairs(monkeypatch, most, held):
    monkeypatch.setattr(near_dedup, "HELD", held)
    monkeypatch.setattr(near_dedup, "SLAB", 20_000)
    made = members(150, copies=False)
    out = near_dedup._proposals(most)(iter([batch_of(*made)]))
    found = {pair for b in out for pair in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    expected = plain(*made, most)
    assert found == expected and len(found) > 100


@pytest.mark.parametrize("most", [3, None])
def test_a_pair_of_blocks_of_copies_takes_little_memory(most):
    """At the default size, every node of one block looks like every node of the other."""
    batch = batch_of(*members(2 * near_dedup.BLOCK_ROWS, copies=True))
    tracemalloc.start()
    try:
        n = sum(len(b) for b in near_dedup._proposals(most)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n > 3 * near_dedup.BLOCK_ROWS and peak < 500e6


def test_pairs_of_a_group_that_are_no_links_are_never_rows(spark, monkeypatch):
    """600 texts of which any two look alike (0.70): the pairs that are joined with texts do not grow with their square."""
    common = [f"w{k}" for k in range(144)]
    rows = [(i, " ".join([*common, *(f"own{i}x{k}" for k in range(30))])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, members, confirmed, buckets = [], [], near_dedup.confirmed, near_dedup.buckets
    monkeypatch.setattr(near_dedup, "confirmed", lambda p, t: pairs.append(p.count()) or confirmed(p, t))
    monkeypatch.setattr(near_dedup, "buckets", lambda n: members.append(buckets(n).count()) or buckets(n))
    found = near_dedup.near_duplicates(docs, Workspace(spark)).collect()
    assert all(r.kept for r in found) and len(found) == 600
    assert sum(pairs) <= 3 * members[0] < 600 * 599 // 4


@pytest.mark.parametrize("cross", [0, 1])
def test_joining_links_are_those_of_all_pairs(cross):
    rng = np.random.default_rng(5)
    common, texts, n = [f"w{k}" for k in range(150)], [], 80
    for _ in range(n):
        at = set(rng.choice(150, 2, replace=False).tolist())
        own = rng.integers(0, 3, 150)
        texts.append(" ".join(f"{w}v{own[k]}" if k in at else w for k, w in enumerate(common)))
    sets, bounds = shingles(W.text_of(pa.array(texts)))

    def spread(size):
        return (W.mixed(sketch(sets, bounds, size)) >> np.uint64(48)).astype("<u2")

    short = spread(COORDINATES)
    short[:, : near_dedup.BAND] = 7
    columns = {
        "key": np.zeros(n, np.int64),
        "band": np.zeros(n, np.int32),
        "first": np.zeros(n, np.int32),
        "second": np.full(n, cross, np.int32),
        "block": np.arange(n, dtype=np.int32) % (1 + cross),
        "node": np.arange(n) * 3 + 5,
        "comp": np.arange(n) // 2,
        "n_shingles": np.diff(bounds),
    }
    batch = batch_of(columns, short, spread(near_dedup.FINE)).append_column("text", pa.array(texts))
    links = {p for b in near_dedup._joining(iter([batch])) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    own = [set(sets[bounds[i] : bounds[i + 1]].tolist()) for i in range(n)]
    true = {
        (i, j)
        for i in range(n)
        for j in range(i + 1, n)
        if i // 2 != j // 2
        and (not cross or i % 2 != j % 2)
        and 100 * len(own[i] & own[j]) >= near_dedup.PERCENT * len(own[i] | own[j])
    }

    def labels(pairs):
        label = list(range(n // 2))
        for i, j in pairs:
            a, b = label[i // 2], label[j // 2]
            label = [min(a, b) if x in (a, b) else x for x in label]
        return label

    found = {((u - 5) // 3, (v - 5) // 3) for u, v in links}
    assert found <= true and labels(found) == labels(true)
    assert 0 < len(found) < n // 2 < len(true)


def test_small_pages_alike_do_not_meet_in_one_task(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    rows = spark.range(3000).select(
        F.col("id").alias("page_id"),
        F.concat(F.lit("http://x/"), F.col("id")).alias("url"),
        F.when(F.col("id") % 3 == 0, F.repeat(F.lit("long "), 300)).otherwise("<p>not found").alias("html"),
    )
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = warc.with_responses(warc.digested(rows))
        assert found.count() == 3000 and found.where("refers_to = 2997").count() == 999
        small = found.where("octet_length(payload) < 1000")
        per_task = [r["count"] for r in small.groupBy(F.spark_partition_id()).count().collect()]
        assert len(per_task) == 8 and max(per_task) < 500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_archives_find_s3_under_spark_s_names(monkeypatch):
    from pyarrow import fs

    asked = []

    class Systems:
        @staticmethod
        def from_uri(uri):
            asked.append(uri)

    monkeypatch.setattr(fs, "FileSystem", Systems)
    for folder in ("s3a://bucket/run", "s3n://bucket/run", "hdfs://host/run", "file:/tmp/run", "/tmp/run"):
        warc._file_system(folder)
    assert asked == ["s3://bucket/run", "s3://bucket/run", "hdfs://host/run", "file:/tmp/run", "file:///tmp/run"]


def test_rounds_of_a_few_links_are_written_in_few_files(spark, tmp_path):
    workspace = Workspace(spark, str(tmp_path))
    wide = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wide}
    try:
        for name, value in wide.items():
            spark.conf.set(name, value)
        links = spark.range(400).selectExpr("id AS u", "id + 1 AS v")
        found = components.components(links, workspace)
        assert found.where("component = 0").count() == found.count() == 400
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    rounds = [p for p in tmp_path.glob("*/stars-*")]
    assert rounds and all(len(list(p.glob("*.parquet"))) <= 8 for p in rounds)


class Frame:
    """Stands for a frame; ``mapInArrow`` gives the function that tasks run."""

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def select(self, *_):
        return self

    def withColumn(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


IN_TASKS = {  # MB of memory for a batch of 8 MB of text, which stands in a batch of Spark's before it comes here
    "classifier": (40, lambda d: quality_classifier.scored(d, quality_classifier.Model(np.ones(1 << 18), 0.0))),
    "rules": (40, lambda d: with_columns(d, "text", quality_rules.COUNTS_SCHEMA, quality_rules.text_counts, W.BLOCK)),
    "sketches": (40, near_dedup.sketched),
    "tokens": (100, lambda d: packing.tokenised(d, public_tokenizers.path("word_bpe_49k.json"))),
}


@pytest.mark.parametrize("step", IN_TASKS)
def test_a_task_works_on_a_part_of_a_large_batch(spark, step):
    """An executor's workers did with whole batches, and kept the memory for the steps after it."""
    rng = np.random.default_rng(8)
    words = np.array(["".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(5000)])
    texts = [" ".join(words[rng.integers(0, len(words), 340)]) for _ in range(4000)]
    ids = pa.array(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["row_id", "doc_id", "text"])
    most, made = IN_TASKS[step]
    run = made(Frame())
    list(run(iter([batch.slice(0, 50)])))  # what a worker process has once
    tracemalloc.start()
    try:
        found = sum(len(b) for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == len(texts) and peak < most * 1e6


def test_known_words_stay_in_order():
    rng = np.random.default_rng(3)
    known = packing.Known(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16))
    hashes = rng.permutation(np.unique(rng.integers(0, 1 << 60, 500).astype(np.uint64)))
    ids = [rng.integers(0, 9000, rng.integers(0, 4)).astype(np.uint16) for _ in hashes]
    for lo, hi in ((0, 200), (200, 200), (200, 201), (201, len(hashes))):
        sizes = np.array([len(x) for x in ids[lo:hi]], np.int64)
        known = known.joined(hashes[lo:hi], sizes, np.concatenate([np.zeros(0, np.uint16), *ids[lo:hi]]))
    at = known.places(hashes)
    assert (np.diff(known.hashes) > 0).all() and (at >= 0).all()
    assert all((known.ids[known.begin[i] : known.end[i]] == x).all() for i, x in zip(at, ids, strict=True))
    assert known.places(np.array([1, 2], np.uint64)).tolist() == [-1, -1]


def test_a_step_of_the_estimates_takes_bins_in_any_order():
    """The bins of a group come in one row, so a task needs no pages for sorts and windows over a handful of rows."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(400, quality_rules.SIZE))
    bins = np.sort(rng.integers(-9, 40, 400))
    of_bin = [rows[bins == b] for b in np.unique(bins)]
    made = [
        {"bin": int(b), "n": len(r), "sums": [*r.sum(0), *[(r[:, i] * r[:, j]).sum() for i, j in quality_rules.PAIRS]]}
        for b, r in zip(np.unique(bins), of_bin, strict=True)
    ]
    group = {"level": 0, "lang_key": "=en", "source_key": "null", "start": 1}
    batch = pa.RecordBatch.from_pylist([group | {"bins": made}, group | {"bins": [made[i] for i in rng.permutation(len(made))]}])
    before = np.cumsum([len(r) for r in of_bin]) - [len(r) for r in of_bin]
    near = np.concatenate([r for r, n in zip(of_bin, before, strict=True) if n < quality_rules.COVERED * 400])
    for found in next(quality_rules._concentrated(iter([batch]))).to_pylist():
        assert found["rows"] == 400 and np.allclose(found["centre"], near.mean(0))
        cov = np.cov(near.T, bias=True) * quality_rules._consistency(quality_rules.COVERED, quality_rules.SIZE)
        assert np.allclose(quality_rules._moments(found)[1], cov + np.diag(quality_rules.LEAST_SPREAD**2))


def kept_after(run):
    """MB that this process has more after a task over 8 MB of text than after one over little."""

    def own():
        found = re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())
        return sum(map(int, found)) / 1024

    rng = np.random.default_rng(8)
    words = np.array(["".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(5000)])
    texts = pa.array([" ".join(words[rng.integers(0, len(words), 340)]) for _ in range(4000)])
    ids = pa.array(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([ids, ids, texts], names=["row_id", "doc_id", "text"])
    sum(len(b) for b in run(iter([batch.slice(0, 50)])))
    rows.give_back()
    before = own()
    sum(len(b) for b in run(iter([batch])))
    return own() - before


@pytest.mark.parametrize("step", IN_TASKS)
def test_a_worker_gives_back_what_a_task_took(spark, step):
    """Worker processes kept it while other steps ran, which counts as their executor's memory."""
    code = "import pickle, sys; from tests.llm import test_bounds as t; print(t.kept_after(pickle.load(sys.stdin.buffer)))"
    run = cloudpickle.dumps(IN_TASKS[step][1](Frame()))
    told = subprocess.run([sys.executable, "-c", code], input=run, capture_output=True, check=True, cwd=Path(__file__).parents[2])
    assert float(told.stdout) < 6


def test_the_tokenizer_goes_when_all_is_tokenised(monkeypatch):
    class Done(Exception):
        pass

    def in_task(_, run, __):
        batch = pa.RecordBatch.from_arrays([pa.array([np.array([7, 2], "<u2").tobytes()])], names=["ids"])
        assert sum(len(b) for b in run(iter([batch]))) == 2
        raise Done

    packing.tokens_of(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(packing, "in_arrow", in_task)
    with pytest.raises(Done):
        packing.document_frequencies(Frame(), np.dtype("<u2"), 10)
    assert packing.tokens_of.cache_info().currsize == 0


def test_the_classifier_gets_a_text_once(spark, monkeypatch):
    """It got the whole row beside the text; every column stays, of any name, in its order."""
    given, real = [], quality_classifier.scored
    monkeypatch.setattr(quality_classifier, "scored", lambda docs, model: real(given.append(docs) or docs, model))
    docs = spark.createDataFrame([(1, "ab", 0.1, 5), (2, None, 0.2, 6)], "`a.b` int, Text string, score double, `row` int")
    model = quality_classifier.Model(np.zeros(1 << 18), 3.0)
    kept = quality_classifier.accepted(docs, model)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))
    assert [f.name for f in given[0].schema["_row"].dataType] == ["a.b", "score", "row"]
    alone = quality_classifier.accepted(docs.select("Text"), model)
    assert alone.columns == ["Text"] and alone.count() == 2


def test_texts_go_to_python_a_thousand_at_a_time(spark):
    before = spark.conf.get(session.ARROW_ROWS)
    try:
        for given, used in (("10000", 1000), ("0", 1000), ("300", 300)):
            spark.conf.set(session.ARROW_ROWS, given)
            queries.text_workspace(spark)
            sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches)
            assert spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] == used
    finally:
        spark.conf.set(session.ARROW_ROWS, before)
