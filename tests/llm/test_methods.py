"""The operators' methods against plain versions of what they compute."""

from __future__ import annotations

import base64
import collections
import hashlib
import io
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from checks.compare import SQL_TYPES, duckdb_on
from grapevine.llm import (
    byte_bpe,
    hmm,
    language_id,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    sketches,
    vector_graph,
    warc,
)
from grapevine.llm import words as W
from grapevine.llm.queries import ORACLE, QUERIES
from grapevine.llm.rows import remainder
from grapevine.session import Workspace

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALPHABET = "abcdefgh  \t\n\r\x0b\x0c\x1c\x85  　'sdtéèßñ漢字カ🙂🇩🇪0123½٣_-#$ςΣ`"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*texts, "", None, " ", "a" * 3000, "ab " * 900 + "   ", "'s't we'll 're", "x" * 1500 + "é" * 700]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    kinds = SQL_TYPES | {"boolean": "BOOLEAN"}
    df = QUERIES[name](spark, SF)
    result = duckdb_on(SF).execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert {f.name: kinds[f.dataType.typeName()] for f in df.schema.fields} == {d[0]: str(d[1]) for d in result.description}
    assert sorted(df.select(*names).collect(), key=repr) == sorted(result.fetchall(), key=repr)


def test_words_are_those_of_the_pattern():
    texts = odd_texts(500)
    vocabulary = W.vocabulary_of(W.text_of(pa.array(texts), lower=True))
    entries = W.strings_of(vocabulary.entries)
    assert len(set(entries)) == len(entries)
    for text, a, b in zip(texts, vocabulary.bounds, vocabulary.bounds[1:], strict=False):
        assert [entries[c] for c in vocabulary.codes[a:b]] == WORD.findall(lowered(text))


def test_byte_ids_are_those_of_the_library():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, texts = byte_bpe.Encoder(path, public_tokenizers.PATTERN), odd_texts(2000)
    ids, bounds = encoder.encode(pa.array(texts))
    for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == library.encode_ordinary(text or "")
        assert byte_bpe.decode(ids[a:b].tolist(), encoder.ranks.bytes_of).decode() == (text or "")
    for piece in (b"a" * 3000, "né".encode() * 900):
        together, _ = byte_bpe.encode_together(np.frombuffer(piece, np.uint8)[None], np.array([len(piece)]), encoder.ranks)
        assert together.tolist() == byte_bpe.encode_alone(piece, encoder.ranks)


def test_encoded_documents_decode_to_their_texts(spark, docs, texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = byte_bpe.decoded(byte_bpe.encoded(docs, path, public_tokenizers.PATTERN), path)
    assert {r.doc_id: r.text for r in back.collect()} == texts


def test_parted_words_have_the_ids_of_the_library():
    # Capitals that combine, signs beside apostrophes, letters and marks outside ASCII.
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    signs = [*"aAhHsStTrReE''''`,.!-123$< \t\n\x1c", *"\u00e9\u00c9\u00df\u00d7\u00f7\u00aa\u00b5\u00b2\u0130\u03a3"]
    signs += "\u0301 \u0307 \u0331 \u0338 \u2014 \u00a0 \u2003 \u212a \ufb01 \uac00 \u1100 \u1161 \U0001f600 \u0663".split(" ")
    rng = np.random.default_rng(11)
    made = ["".join(signs[i] for i in rng.integers(0, len(signs), rng.integers(0, 30))) for _ in range(5000)]
    ids, bounds = packing.Tokens(path).encode(pa.array(made))
    for text, a, b in zip(made, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_pieces_hold_every_id_once(spark, docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    odd = odd_texts(500)
    ids, bounds = packing.Tokens(path).encode(pa.array(odd))
    for text, a, b in zip(odd, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    found, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.packed(docs, path, Workspace(spark)).collect():
        found[r.doc_id].append((r.start, list(np.frombuffer(r.ids, "<u4")), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, pieces in found.items():
        whole = list(itertools.chain.from_iterable(p[1] for p in sorted(pieces)))
        assert whole == [*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 2]
        assert {p[2] for p in pieces} == {len(whole)}
    assert set(found) == set(texts)
    for pieces in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(pieces)))
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]]
        assert ends[-1] == packing.WINDOW or ends[-1] & (ends[-1] - 1) == 0


def test_index_scores_are_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 30, rng.integers(1, 40)) for _ in range(25)]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    idf = rng.random(30)
    index = packing.Index(np.concatenate(docs), bounds, idf, 20.0)
    query = index.terms_of(3)
    assert query.tolist() == sorted(set(docs[3].tolist()))
    k1, b = packing.K1, packing.B
    plain = [
        sum(idf[t] * f * (k1 + 1) / (f + k1 * (1 - b + b * len(d) / 20)) for t in query if (f := (d == t).sum()))
        for d in docs
    ]
    assert np.allclose(index.scores(query), plain)


def test_short_texts_shape_the_states_and_rounds_go_on_while_they_help(spark, monkeypatch):
    texts = [" ".join(f"l{i}" for i in range(600)), *[f"short {i}" for i in range(50)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    read = Workspace(spark).keep(hmm.blocks(docs, F.lit(False)), "blocks")
    sizes = sorted(len(s) for s in hmm.warm_stretches(read))
    assert sizes == [3] * 50 + [89, 512]
    totals = iter([-100.0, -90.0, -85.0, -84.0, -83.99, -80.0])
    monkeypatch.setattr(hmm, "_one_round", lambda read, model, share: (model + 1, next(totals)))
    assert hmm.fitted(None, 0, None) == 5


def test_near_copies_meet_in_small_shards(spark, monkeypatch):
    """Copies far apart in the file share a sequence, though all texts have the common words."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 6000)
    rng = random.Random(6)
    rare = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(4000)]
    texts = [" ".join([*rng.sample(rare, 25), *("the of and to in is it that was for end" * 2).split()]) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate([*texts, *[t.rsplit(" ", 3)[0] for t in texts]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), Workspace(spark)).collect()
    at = collections.defaultdict(set)
    for r in packed:
        at[r.doc_id].add(r.sequence_id)
    assert sum(bool(at[i] & at[i + 400]) for i in range(400)) >= 300


def test_forward_probability_sums_over_all_paths():
    rng = np.random.default_rng(5)
    k = 3
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(6), k).T)
    sequences = [rng.integers(0, 6, n) for n in (1, 4, 6)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    found = hmm.log_likelihood(model, np.concatenate(sequences), bounds)
    for value, s in zip(found, sequences, strict=True):
        paths = itertools.product(range(k), repeat=len(s))
        total = sum(
            model.first[p[0]] * math.prod(model.steps[a, b] for a, b in itertools.pairwise(p))
            * math.prod(model.emits[o, q] for o, q in zip(s, p, strict=True))
            for p in paths
        )
        assert math.isclose(value, math.log(total), rel_tol=1e-9)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(6)
    sequences = [rng.integers(0, 40, 60) + 40 * (i % 2) for i in range(60)]
    classes = np.concatenate(sequences)
    bounds = np.arange(0, 3601, 60)
    share = (np.bincount(classes, minlength=hmm.CLASSES) + 1) / (len(classes) + hmm.CLASSES)
    model, values = hmm.start(share), []
    for _ in range(25):
        first, steps, emits, total = hmm.expected_counts(model, classes, bounds, np.ones(60, bool))
        assert math.isclose(emits.sum(), len(classes)) and math.isclose(steps.sum(), len(classes) - 60)
        assert math.isclose(total, hmm.log_likelihood(model, classes, bounds).sum())
        values.append(total)
        model = hmm.improved(first, steps, emits, share)
    assert values[-1] > values[0]


def test_model_counts_and_beats_the_base(spark, docs, texts):
    rows = hmm.scored(docs, remainder("doc_id", 7) == 2, Workspace(spark)).collect()
    tokens = {i: [*WORD.findall(lowered(t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(own), n)
        assert r.n_known == sum(counts[w] > 0 for w in own)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_counts_of_texts_are_those_of_the_definition(texts):
    own = [*texts.values(), "a b c d e " * 3, "one\n\none\n \none x\n", "€ | <é>"]
    found = quality_rules.text_counts(pa.array(own))
    for i, text in enumerate(own):
        ws, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        covered = {k + j for k in range(len(ws) - 4) if windows[tuple(ws[k : k + 5])] > 1 for j in range(5)}
        expected = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        assert tuple(int(found[c][i]) for c in quality_rules.COUNTS[:4]) == expected
        assert found["n_repeat_words"][i] == len(covered)


def test_outliers_are_rejected_and_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality_rules.quality_rules(docs, Workspace(spark)).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = [r for r in found if r.quality == 1], [r for r in found if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.6 * len(bad)


def test_chi_square_quantile():
    assert math.isclose(quality_rules.chi_square_quantile(0.95, 7), 14.067, rel_tol=0.01)


def test_classifier_on_documents_it_did_not_learn_from(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_classifier.fit(docs, labels, remainder("doc_id", 4) != 2)
    held = quality_classifier.scored(docs.select("doc_id", "text"), model).join(labels, "doc_id")
    rows = held.where(remainder("doc_id", 4) == 2).collect()
    right = sum((r.score >= quality_classifier.THRESHOLD) == bool(r.quality) for r in rows)
    assert right >= 0.9 * len(rows)


def test_rows_that_repeat_an_id_teach_once(spark):
    """A labelled id on very many rows brings one example to the task that learns."""
    texts = [(i, f"good words here {i}" if i % 2 else f"bad signs there {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once, often = (
        quality_classifier.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, F.lit(True))
        for rows in (texts, [*texts, *[(1, f"other bad signs there {i}") for i in range(500)]])
    )
    assert once.constant == often.constant and np.array_equal(once.weights, often.weights)


def test_languages_of_documents_it_did_not_learn_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, remainder("doc_id", 3) != 1)
    rows = language_id.labelled(docs, model, "doc_id", "lang").where(remainder("doc_id", 3) == 1).collect()
    rows = [r for r in rows if r.lang is not None and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5):
        scores = rng.normal(0, 3, (n, 3))
        labels = language_id.viterbi(scores, np.array([0, 0, n]), 2.0)
        worth = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 2 * sum(a != b for a, b in itertools.pairwise(p))  # noqa: B023, E731
        assert math.isclose(worth(labels.tolist()), max(map(worth, itertools.product(range(3), repeat=n))))


def test_spans_of_mixed_text(spark):
    model_docs = spark.createDataFrame(
        [(1, "the of and to in that is was", "en"), (2, "der die und zu in das ist war", "de"), (3, "мир да нет", "ru")],
        "doc_id long, text string, lang string",
    )
    model = language_id.fit(model_docs, remainder("doc_id", 3) >= 0)
    mixed = spark.createDataFrame([(9, "the and that was " * 6 + "der die das und " * 6 + "нет мир " * 4)], "doc_id long, text string")
    spans = [(r.first_word, r.n_words, r.span_lang) for r in language_id.span_table(mixed, model).collect()]
    assert spans == [(0, 24, "en"), (24, 24, "de"), (48, 8, "ru")]


def test_sketches_estimate_similarity_and_fill():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for n, shared in ((400, 300), (3, 2), (1, 1), (1000, 200)):
        a, b = base[:n], np.concatenate([base[:shared], base[2000 : 2000 + n - shared]])
        rows = sketches.sketch(np.concatenate([a, b]), np.array([0, n, 2 * n]), 512)
        assert (rows != np.iinfo(np.uint64).max).all()
        assert abs((rows[0] == rows[1]).mean() - shared / (2 * n - shared)) < 0.11
    assert (sketches.sketch(base[:0], np.array([0, 0])) == 0).all()


def test_near_copies_chain_and_blocks(spark, monkeypatch):
    """Copies of copies, in buckets that are compared block by block, are one component as by plain comparison."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    rng, words = random.Random(7), [f"w{i}" for i in range(400)]
    rows, text = [], words[:60]
    for i in range(40):
        text = list(text)
        text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(rng.sample(words, 30))) for i in range(20)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_duplicates(docs, Workspace(spark)).collect()
    assert {r.doc_id: r.component_id for r in found} == least
    assert len(set(least.values())) < len(rows)


def test_vector_links_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", 120)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16))
    near = np.concatenate([base, base[:200] + rng.normal(scale=0.03, size=(200, 16)), base[:100]]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2 if i < 0 else 1) for i, v in enumerate(near)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = near.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.98).sum(1) - 1
    found = vector_graph.near_vectors(vectors, Workspace(spark)).collect()
    assert sum(r.n_links for r in found) >= 0.95 * links.sum()
    assert all(r.n_links <= links[r.vec_id] for r in found)
    assert found[0].recall >= 0.9


def test_a_dense_group_of_vectors_is_compared_whole(spark, monkeypatch):
    """Splitting does not make it smaller: its rows do not multiply, and every link is found."""
    monkeypatch.setattr(vector_graph, "SHARD", 100)
    monkeypatch.setattr(vector_graph, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(4)
    near = rng.normal(size=16) + rng.normal(scale=0.13, size=(150, 16))
    x = near.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [("a", i, v.tolist()) for i, v in enumerate(near)]
    nodes = spark.createDataFrame(rows, "label string, node long, embedding array<float>")
    members, dense = vector_graph.shards(nodes, 0.1, Workspace(spark))
    assert (members.count(), dense.count()) == (0, 150)
    found = {(r.u, r.v) for r in vector_graph.links(nodes, 0.1, 24, Workspace(spark)).collect()}
    assert found == {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1)), strict=True)}
    assert 0 < len(found) < 150 * 149 // 2


def test_links_across_clusters_are_found_if_the_search_misses_them(spark, monkeypatch):
    """A vector joins all clusters that are as near, and a run below the recall goes the exact way."""
    assert vector_graph._parts(np.full((2, 6), 0.9), 0.1)[1].tolist() == [0, 1, 2, 3, 4, 5] * 2
    monkeypatch.setattr(vector_graph, "SHARD", 60)
    monkeypatch.setattr(vector_graph, "ATTEMPTS", ((0.0, 1),))
    rng = np.random.default_rng(5)
    turns = np.sort(rng.uniform(0, 2 * np.pi, 500))  # links along a circle, so that every border cuts some
    near = np.stack([np.cos(turns), np.sin(turns), np.zeros(500)], 1).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(near)]
    x = near.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.98).sum(1) - 1
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    labels = vectors.select("label", F.col("vec_id").alias("node"), "embedding")
    assert vector_graph.links(labels, 0.0, 1, Workspace(spark)).count() < 0.95 * links.sum() / 2
    found = vector_graph.near_vectors(vectors, Workspace(spark)).collect()
    assert {r.vec_id: r.n_links for r in found} == dict(enumerate(links.tolist()))
    assert found[0].recall == 1


def test_pruning_keeps_the_nearest_and_drops_what_it_covers():
    x = np.array([[1, 0], [0.99, 0.1], [0.98, 0.12], [0, 1.0]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert vector_graph.pruned_neighbours(x @ x.T, np.array([1, 2, 3]), 0) == [1, 3]


def test_groups_go_where_most_is_left():
    shards = list(sharding.place(iter(np.array([[3.0, 0], [0, 3.0], [1, 0], [0, 1]])), np.full((2, 2), 4.0)))
    assert shards == [0, 0, 1, 1]


def test_equal_texts_share_a_shard(spark, docs):
    rows = sharding.sharded(docs, Workspace(spark))
    assert rows.groupBy("text_crc32", "size").agg({"shard": "min", "*": "count"}).count() > 0
    sizes = [r[0] for r in rows.groupBy("shard").sum("size").select("sum(size)").collect()]
    assert max(sizes) < 1.3 * min(sizes)


def test_records_come_back_from_an_archive():
    rng = random.Random(9)
    payloads = [(f"<p>{rng.random()} " + "body of the page " * rng.randrange(80)).encode() for _ in range(200)]
    records = [
        warc.record_bytes(i, f"http://x/{i} y", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads)
    ]
    out = io.BytesIO()
    n, size = warc.write_archive(out, iter(records[100:]), records[:100])
    assert (n, size) == (200, len(out.getvalue()))
    assert out.getvalue()[:4] == b"\x5d\x2a\x4d\x18"
    out.seek(0)
    assert list(warc.read_archive(out)) == records
    assert [warc.parsed(r)["payload_bytes"] for r in records] == [len(p) for p in payloads]
    damaged = records[0].replace(b"body", b"busy")
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(damaged if damaged != records[0] else records[0][:-20] + b"x" * 20)
    cut = io.BytesIO(out.getvalue()[:-5])
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_archive(cut))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns and kept.count() < before, name
    assert kept.select("doc_id").distinct().count() == kept.count()
    pieces = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
