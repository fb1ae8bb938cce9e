"""Merkle climbs, fill-in-middle texts and mixtures against plain versions of what they compute."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grapevine.llm import merkle, middles, mixing
from grapevine.llm import words as W
from grapevine.llm.queries import QUERIES
from grapevine.session import Workspace

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ALPHABET = "ab  \t\n\x0b\x1c\x85 é漢🙂<>PSM"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, row_id long, n int, place int"


def made_rows(n, seed=3):
    rng = random.Random(seed)
    rows = [
        (
            i,
            rng.choice(["a", "a", "a", "b", "ü", "😀", "", None]),
            rng.choice(["en", None]),
            i % 7 or None,
            "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))),
        )
        for i in range(n)
    ]
    rows += [(n, "lone", "en", 1, "x\ny"), (n + 1, "b", None, None, None), (n + 2, "b", "de", 0, "")]
    rows += [(n + 3, "a", "en", 5, "longer\n text " * 20_000), (None, "a", "en", 2, "no id\n"), (None, None, None, None, None)]
    return rows + [rows[1], rows[1], (2, "a", "en", 9, "same id, other text")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, 6, 7) for r in rows], SCHEMA).repartition(3).persist()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    fields = [None if v is None else str(v) for v in (*row[:4], text)]
    return sha("".join("-" if f is None else f"{len(f.encode())}:{f}" for f in fields))


def up(level):
    return [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(up(levels[-1]))
    return levels


def path(levels, at):
    for level in levels[:-1]:
        begin = at - at % 3
        yield "".join(level[begin:at]), "".join(level[at + 1 : begin + 3])
        at //= 3


def plain_climbs(rows):
    by_source = {}
    for row in rows:
        text = row[4]
        even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        seen = text.replace("\n", "") if even and text is not None else text
        by_source.setdefault(row[1], []).append((row[0], plain_leaf(row, text), plain_leaf(row, seen)))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for found in by_source.values():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [plain_tree([x[1] for x in by_source[s]]) for s in sources]
    top = plain_tree([t[-1][0] for t in trees])
    for k, source in enumerate(sources):
        for i, (doc_id, leaf, seen) in enumerate(by_source[source]):
            steps = [*path(trees[k], i), *path(top, k)]
            folded = seen
            for before, after in steps:
                folded = sha(before + folded + after)
            proof = sha("".join(b + a for b, a in steps))
            yield doc_id, leaf, trees[k][-1][0], top[-1][0], proof, folded, folded == top[-1][0]


def climbs(spark, docs):
    tables = Workspace(spark)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    seen = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.climbed(merkle.manifest(docs, tables, seen={"text": seen}), tables)
    return found.withColumn("proof", F.sha2(F.lower(F.hex("proof")).cast("binary"), 256))


@pytest.mark.parametrize("n", [0, 1, 40, 700])
def test_climbs(spark, n):
    rows = made_rows(n) if n > 1 else made_rows(40)[:n]
    found = [tuple(r) for r in climbs(spark, frame(spark, rows)).collect()]
    assert sorted(found, key=repr) == sorted(plain_climbs(rows), key=repr)
    if n > 1:
        assert {r[-1] for r in found} == {True, False}


def test_nodes_above_many_leaves_are_stored_several_times(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 10)
    rows = made_rows(300)
    docs = frame(spark, rows)
    made = merkle.manifest(docs, Workspace(spark))
    largest = max(sum(r[1] == source for r in rows) for source in {r[1] for r in rows})
    assert made.nodes.where("tree = -1").agg(F.max("time")).first()[0] + 1 == -(-largest // 10)
    assert sorted(map(tuple, climbs(spark, docs).collect()), key=repr) == sorted(plain_climbs(rows), key=repr)


def test_a_climb_keeps_spark_s_limits(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    climbs(spark, frame(spark, made_rows(5)))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_untouched_copies_verify(spark):
    tables = Workspace(spark)
    rows = merkle.climbed(merkle.manifest(frame(spark, made_rows(50)), tables), tables)
    assert rows.where("NOT verified").count() == 0


def plain_form(row, text):
    digest = sha(f"42:{'' if row[0] is None else row[0]}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    tokens = TOKEN.findall(text)
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return row[0], len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return row[0], len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return row[0], len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middles(spark):
    rows = made_rows(1500)
    docs = frame(spark, rows)
    expected = [plain_form(r, r[4] or "") for r in rows]
    assert {f[2] for f in expected} == {"plain", "spm", "psm"}
    assert any("<P>" in f[5] for f in expected if f[2] == "plain")
    found = middles.transformed(docs)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    again = found.select("doc_id", middles.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(((r[0], r[4] or "") for r in rows), key=repr)


def test_boundaries_are_those_of_the_pattern():
    texts = [r[4] for r in made_rows(400)] + ["  ", " a", "a ", "é 漢", " \n "]
    offsets, bounds = middles.boundaries(W.text_of(pa.array(texts)))
    for i, text in enumerate(texts):
        own = offsets[bounds[i] : bounds[i + 1]].tolist()
        assert own == [0, *[m.end() for m in TOKEN.finditer(text or "")]]


@pytest.mark.parametrize("error", [0, 3, 127])
def test_the_index_is_exact_and_bounded(error):
    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, 1, 5000, 1, 40_000]
    parts = [np.cumsum(np.concatenate([[0], rng.choice([1, 2, 9, 300], n - 1)])) for n in sizes]
    offsets, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
    index = middles.fitted(offsets, bounds, error)
    assert (index.offsets(np.arange(len(offsets))) == offsets).all()
    assert np.abs(index.residuals.astype(int)).max() <= error
    assert set(bounds[:-1]) <= set(index.starts.tolist())  # no segment passes a text's end
    words = np.cumsum(rng.choice([2, 4, 6, 9, 14], 40_000))  # lengths as words have them take few segments
    assert len(middles.fitted(words, np.array([0, len(words)])).starts) < len(words) / 100
    assert len(middles.fitted(np.zeros(0, np.int64), np.zeros(1, np.int64)).starts) == 0


def plain_targets(sizes):
    """Shares by weight; what is above twice its size stops there, and the excess goes to the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, stopped = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in stopped)
        weights = sum(weight[s] for s in sizes if s not in stopped)
        target = {s: 2.0 * sizes[s] if s in stopped else left * weight[s] / weights for s in sizes}
        above = {s for s in sizes if target[s] > 2 * sizes[s]}
        if not above:
            return target
        stopped |= above


def mixed(spark, rows):
    docs = frame(spark, rows)
    made = mixing.mixture(docs, Workspace(spark))
    return docs, made, mixing.planned(made).collect()


def test_targets_and_copies(spark):
    rows = made_rows(600)
    docs, made, found = mixed(spark, rows)
    words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert sorted((repr(r[0]), repr(r[1]), words(r[4])) for r in rows) == sorted((repr(r.doc_id), repr(r.source), r["size"]) for r in found)
    sizes = {}
    for r in rows:
        sizes[r[1]] = sizes.get(r[1], 0) + words(r[4])
    targets = plain_targets(sizes)
    assert any(targets[s] == 2 * sizes[s] for s in sizes) and any(targets[s] < 2 * sizes[s] for s in sizes)
    alike = {}
    for r in rows:
        alike.setdefault((r[0], r[1], r[4]), []).append(r)
    expected = []
    for (doc_id, source, text), same in alike.items():
        rate = targets[source] / sizes[source] if sizes[source] else 0
        digest = sha(f"42:{'' if doc_id is None else doc_id}:{text or ''}")
        extra = len(same) * (rate - int(rate))
        extra = int(extra) + (int(digest[:13], 16) / 16**13 < extra - int(extra))
        expected += [(repr(doc_id), repr(source), int(rate) + (i < extra)) for i in range(len(same))]
    assert sorted(expected) == sorted((repr(r.doc_id), repr(r.source), r.copies) for r in found)
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) <= 1e-9 * r.target
        assert 0 <= r.copies <= 2

    texts = mixing.emitted(docs, made)
    assert texts.columns == docs.columns
    emitted = {}
    for r in texts.collect():
        emitted[repr(tuple(r))] = emitted.get(repr(tuple(r)), 0) + 1
    plan = {}
    by_key = {(repr(k[0]), repr(k[1]), words(k[2])): repr((*same[0], "x", 5, 6, 7)) for k, same in alike.items()}
    for r in found:
        key = by_key[repr(r.doc_id), repr(r.source), r["size"]]
        plan[key] = plan.get(key, 0) + r.copies
    assert emitted == {k: n for k, n in plan.items() if n}


def test_a_document_that_is_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 100)
    monkeypatch.setattr(mixing, "SOURCES", 0)
    rows = [(i if i % 3 else -1, "ab"[i % 2], "en", 1, f"word {i if i % 3 else 0} " * 9) for i in range(6000)]
    docs, made, found = mixed(spark, rows)
    assert len(found) == 6000
    for source in "ab":
        own = [r for r in found if r.source == source]
        assert abs(sum(r["size"] * r.copies for r in own) - own[0].target) < 0.1 * own[0].target
    assert mixing.emitted(docs, made).count() == sum(r.copies for r in found)


def test_few_and_no_documents(spark):
    for rows in ([], [(1, "a", None, None, "one two")], [(1, None, None, None, None)]):
        docs, made, found = mixed(spark, rows)
        assert len(found) == len(rows)
        assert mixing.emitted(docs, made).count() == sum(r.copies for r in found)
        assert middles.transformed(docs).count() == len(rows)
    assert found[0].target == 0 and found[0].copies == 0


def test_sources_stay_near_their_targets(spark):
    rows = QUERIES["op13_repeated_mixture"](spark, "/root/testdata/sf0.1")
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source")
    sums = rows.join(documents, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert all(abs(r.taken - r.target) < 0.1 * r.target for r in sums.collect())
