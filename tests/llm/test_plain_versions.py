"""Methods against plain loops."""

from __future__ import annotations

import collections
import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from grapevine.llm import packing, quality_classifier, quality_rules, sharding
from grapevine.session import Workspace


@pytest.mark.parametrize("remembered", [0, 3, 600_000])
def test_remembered_words_keep_their_ids(remembered):
    """Blocks one after the other, with words that come again, hold the tokenizer's mark, or are forgotten."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokens = packing.Tokens(path, remembered)
    blocks = [
        ["one two two `tick` one", None, "", "café café, `tick`"],
        ["two three-three one's three-three", "   ", "three-three `tick` ```"],
        [],
        ["café one two `tick` three-three", "five"],
    ]
    for block in blocks:
        ids, bounds = tokens.encode(pa.array(block, pa.string()))
        expected = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in block]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == expected
        assert len(tokens.known.hashes) <= remembered
        assert (np.diff(tokens.known.hashes.astype(object)) > 0).all()
    assert remembered < 10 or len(tokens.known.hashes) > 5


def test_an_index_without_used_pieces_scores_the_others_alike():
    rng = np.random.default_rng(8)
    docs = [rng.zipf(1.5, rng.integers(1, 50)).clip(0, 199) for _ in range(60)]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    index = packing.Index(np.concatenate(docs), bounds, rng.random(200), 20.0)
    assert len(index.rows) and len(index.piece)
    queries = [index.terms_of(i) for i in (0, 7, 59)]
    whole = [index.scores(q) for q in queries]
    left = np.arange(60)
    for share in (0.7, 0.5, 0.0):
        live = rng.random(len(left)) < share
        index.keep(live)
        left = left[live]
        assert all(np.allclose(index.scores(q), w[left], rtol=1e-12) for q, w in zip(queries, whole, strict=True))
    assert index.terms_of(7).tolist() == queries[1].tolist()


def plain_windows(docs, idf, mean_size):
    """The greedy fill without an index: every live piece is scored again for every window."""
    size = packing.WINDOW
    left = {i: len(ids) % size for i, (_, ids) in enumerate(docs)}
    rest = {i: ids[len(ids) // size * size :] for i, (_, ids) in enumerate(docs) if left[i]}
    done = {i: 0 for i in rest}
    out = [[(docs[i][0], at, size)] for i in range(len(docs)) for at in range(0, len(docs[i][1]) // size * size, size)]

    def score(query, i):
        times = collections.Counter(rest[i].tolist())
        norm = packing.K1 * (1 - packing.B + packing.B * len(rest[i]) / mean_size)
        return sum(idf[t] * times[t] * (packing.K1 + 1) / (times[t] + norm) for t in sorted(query) if times[t])

    for seed in sorted(rest, key=lambda i: (-len(rest[i]), i)):
        if not left[seed]:
            continue
        query, window, space = set(rest[seed].tolist()), [], size

        def put(i, n):
            window.append((docs[i][0], len(docs[i][1]) // size * size + done[i], n))
            done[i] += n
            left[i] -= n
            return n

        space -= put(seed, left[seed])
        ranked = sorted((i for i in rest if left[i]), key=lambda i: (-round(score(query, i), 9), i)) if space else []
        for i in ranked:
            if left[i] <= space:
                space -= put(i, left[i])
        unused = [i for i in ranked if left[i]]
        if space and unused:
            put(unused[0], space)
        out.append(window)
    return out


def test_windows_are_filled_as_by_scoring_all_pieces(monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 64)
    rng = np.random.default_rng(12)
    # Scores are drawn apart by a term's own rarity, so that rounding decides no tie.
    docs = [(f"d{i}", rng.zipf(1.3, rng.integers(1, 150)).clip(0, 299).astype("<u2")) for i in range(150)]
    idf = rng.random(300) + 0.1
    windows = list(packing.packed_shard(docs, idf, 30.0, None))
    made = [[(key, start, len(ids)) for key, start, _, ids in w.pieces] for w in windows]
    assert made == plain_windows(docs, idf, 30.0)
    assert sum(n for w in made for *_, n in w) == sum(len(ids) for _, ids in docs)


def plain_leader(examples, settings):
    """Follow the regularised leader, one coordinate at a time."""
    size = 1 << quality_classifier.BITS
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= settings.l1:
            return 0.0
        sign = math.copysign(1.0, z[i])
        return -(z[i] - sign * settings.l1) / ((settings.beta + math.sqrt(n[i])) / settings.alpha + settings.l2)

    for _ in range(settings.rounds):
        for label, buckets, values in examples:
            own = [*zip(buckets.tolist(), values.tolist(), strict=True), (size, 1.0)]
            w = {i: weight(i) for i, _ in own}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in own)))
            for i, v in own:
                g = (p - label) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / settings.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_updates_are_those_of_a_plain_loop():
    rng = np.random.default_rng(21)
    examples = []
    for _ in range(300):
        at = np.unique(rng.integers(0, 500, rng.integers(0, 40)))
        label = int((at % 5 == 0).sum() > (at % 5 == 1).sum())
        examples.append((label, at, rng.random(len(at))))
    settings = quality_classifier.Leader()
    weights, constant = quality_classifier.train(iter(examples), settings)
    plain = plain_leader(examples, settings)
    assert math.isclose(constant, plain.pop(1 << quality_classifier.BITS), rel_tol=1e-9)
    assert np.allclose(weights[list(plain)], list(plain.values()), rtol=1e-9, atol=1e-12)
    assert set(np.flatnonzero(weights)) == {i for i, w in plain.items() if w}
    assert any(plain.values()) and not all(plain.values())  # some are held at nil by the first penalty


def test_scores_are_the_logistic_of_a_plain_dot_product():
    texts = ["good words are good words", "bad bad, spam!!", "", None, "one", "x " * 5000 + "end"]
    buckets, bounds = quality_classifier.features(pa.array(texts))
    rng = np.random.default_rng(2)
    model = quality_classifier.Model(rng.normal(size=1 << quality_classifier.BITS), -0.25)
    expected = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        dot = sum(model.weights[i] for i in buckets[a:b].tolist()) / math.sqrt(max(1, b - a))
        expected.append(1 / (1 + math.exp(-(dot + model.constant))))
    assert np.allclose(model.scores(pa.array(texts)), expected)
    # Runs, of signs too, neighbours, and one for "bad bad".
    assert np.diff(bounds).tolist()[:5] == [5 + 4, 5 + 4 + 1, 0, 0, 1]


def test_each_vector_goes_where_the_dot_product_is_highest():
    rng = np.random.default_rng(31)
    vectors = rng.random((400, 3)) / 400
    capacity = np.full((8, 3), 1 / 8)
    left, expected = capacity.copy(), []
    for v in vectors.tolist():
        best = max(range(8), key=lambda s: (sum(x * y for x, y in zip(left[s], v, strict=True)), -s))
        expected.append(best)
        left[best] -= v
    assert list(sharding.place(iter(vectors), capacity)) == expected
    assert np.ptp(left, axis=0).max() < 0.01  # all three are balanced


def test_equal_texts_share_a_shard_unless_their_group_is_large(spark):
    rng = np.random.default_rng(41)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 900, 20)) for _ in range(2000)]
    rows = [(i, texts[i // 2]) for i in range(4000)] + [(i, "hot " * 20) for i in range(4000, 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in sharding.sharded(docs, Workspace(spark)).collect()}
    assert all(found[i].shard == found[i + 1].shard for i in range(0, 4000, 2))
    assert len({found[i].shard for i in range(4000, 6000)}) == 8  # a third of all rows does not fit one shard
    sizes = [[r.size for r in found.values() if r.shard == s] for s in range(8)]
    loads = np.array([[len(own), sum(own)] for own in sizes])
    assert (loads.max(0) < 1.02 * loads.min(0)).all()
    for s in range(8):
        assert sorted(r.slot for r in found.values() if r.shard == s) == list(range(loads[s, 0]))


def _vectors(spark, groups):
    """Rows of statistics by language and source."""
    names = quality_rules.NAMES
    rows = [(lang, source, *map(float, x)) for (lang, source), own in groups.items() for x in own]
    return spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{n} double" for n in names))


def _normal(rng, rows, centre=0.0):
    mixing = np.eye(quality_rules.SIZE) + 0.4 * np.tri(quality_rules.SIZE, k=-1)
    return centre + rng.normal(size=(rows, quality_rules.SIZE)) @ mixing.T


def _plain_determinant_estimate(x):
    """Concentration steps on sorted distances; of the starts the one with the least determinant."""
    best = None
    size = quality_rules.SIZE
    least = np.diag(quality_rules.LEAST_SPREAD**2)
    low, middle, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    spread = np.hypot((high - low) / 1.349, quality_rules.LEAST_SPREAD)
    for scale in quality_rules.SPREADS:
        centre, cov = middle, np.diag((spread * scale) ** 2)
        for _ in range(quality_rules.STEPS):
            d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            near = x[np.argsort(d2, kind="stable")[: math.ceil(quality_rules.COVERED * len(x))]]
            centre = near.mean(0)
            cov = np.cov(near.T, bias=True) * quality_rules._consistency(quality_rules.COVERED, size) + least
        found = (np.linalg.slogdet(cov)[1], centre, cov)
        best = found if best is None or found[0] < best[0] else best
    return best[1:]


def test_estimates_are_those_of_plain_concentration_steps(spark):
    """Also where a fifth of a group, all in one place, are outliers, and in a group that is mostly one vector."""
    rng = np.random.default_rng(5)
    groups = {
        ("x", "clean"): _normal(rng, 500),
        ("x", "dirty"): np.concatenate([_normal(rng, 400, 3.0), _normal(rng, 100, 15.0)]),
        ("y", None): np.concatenate([np.repeat(_normal(rng, 1), 60, axis=0), _normal(rng, 20)]),
    }
    workspace = Workspace(spark)
    fits = quality_rules.fit(workspace.keep(_vectors(spark, groups), "vectors"), workspace).where("level = 0").collect()
    by_key = {(r.lang_key, r.source_key): r.asDict() for r in fits}
    assert len(by_key) == len(groups)
    for (lang, source), x in groups.items():
        own = by_key[f"={lang}", "null" if source is None else f"={source}"]
        centre, cov = quality_rules._moments(own)
        expected, wanted = _plain_determinant_estimate(x)
        scale = np.sqrt(np.diag(wanted))
        assert own["rows"] == len(x)
        # Bins hold more than one distance, so the nearest share differs by a few rows.
        assert np.abs((centre - expected) / scale).max() < 0.15
        assert np.abs((cov - wanted) / np.outer(scale, scale)).max() < 0.25
    assert np.abs(quality_rules._moments(by_key["=x", "=dirty"])[0] - 3.0).max() < 0.5


def test_an_estimate_is_drawn_towards_the_coarser_one_as_by_rows_of_it():
    """Centre and covariance of the group's rows together with rows of the coarser estimate."""
    rng = np.random.default_rng(6)
    coarse = _normal(rng, quality_rules.PRIOR_ROWS, 2.0)
    coarser = coarse.mean(0), np.cov(coarse.T, bias=True)
    for rows in (20, 59, 60, 500):
        own = _normal(rng, rows)
        whitener = np.linalg.inv(np.linalg.cholesky(np.cov(own.T, bias=True)))
        fitted = {"rows": rows, "centre": own.mean(0).tolist(), "whitener": whitener.ravel().tolist()}
        centre, cov = quality_rules.drawn_towards(fitted, coarser)
        both = np.concatenate([own, coarse])
        assert np.allclose(centre, both.mean(0)) and np.allclose(cov, np.cov(both.T, bias=True))


def test_a_row_more_hardly_changes_how_a_group_is_judged(spark):
    """No number of rows switches a group from one estimate to another."""
    rng = np.random.default_rng(7)
    rest, own = _normal(rng, 300), _normal(rng, 61, 4.0)
    workspace, found = Workspace(spark), []
    for rows in (59, 60, 61):
        groups = {("x", "large"): rest, ("x", "small"): own[:rows]}
        fits = quality_rules.fit(workspace.keep(_vectors(spark, groups), "vectors"), workspace)
        (small,) = quality_rules.estimates(fits).where("source_key = '=small'").collect()
        found.append(np.array(small["centre"]))
    assert np.abs(np.diff(found, axis=0)).max() < 0.25
    assert all(1.0 < np.mean(c) < 4.0 for c in found)
