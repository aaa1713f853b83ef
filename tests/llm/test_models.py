"""Toxicity and quality models: brute-force counts, held-out accuracy, constraints."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm.conftest import LONG, ODD_TEXTS

from rentatlas.llm import labelled, quality, queries, toxicity

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    times = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = set()
    for i in range(len(words) - 2):
        if times[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(inside))


def test_counts_are_those_of_plain_python():
    rng = random.Random(1)
    bits = ["a", "b", "é", " ", "\n", " a b c", "\t", "\x0b", " ", "#", "\x1c", "a a a",
            "\r\n", "日", "|"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(4000)]
    texts += ["", " ", LONG, LONG + " " + LONG]
    for at in range(0, len(texts), 300):
        some = texts[at : at + 300]
        counts, features = quality.measure(pa.array(some, pa.string()))
        got = list(zip(*[counts[c].tolist() for c in quality.COUNTS], strict=True))
        assert got == [brute_counts(t) for t in some]
        assert np.isfinite(features).all() and features.shape[1] == len(quality.FEATURES)


def test_trees_keep_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = (x[:, 2] + 0.3 * np.sin(20 * x[:, 2]) + 0.2 * rng.random(3000) < 0.6).astype(float)
    trees = quality.fit(x, y, trees=30)
    at = x[:50].copy()
    before = None
    for v in np.linspace(0, 1, 40):
        at[:, 2] = v
        score = trees.score(at)
        assert before is None or (score <= before + 1e-12).all()
        before = score
    assert ((trees.score(x) > 0.5) == (y > 0)).mean() > 0.85


def test_flat_nodes_give_the_scores_of_a_walk():
    rng = np.random.default_rng(1)
    x = rng.random((500, len(quality.FEATURES)))
    trees = quality.fit(x, (x[:, 0] + x[:, 1] > 1).astype(float), trees=8, depth=3)
    for row in x[:40]:
        total = trees.start
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value, strict=True):
            node = 0
            for _ in range(trees.depth):
                node = 2 * node + (1 if row[feature[node]] <= cut[node] else 2)
            total += value[node]
        assert total == pytest.approx(trees.log_odds(row[None])[0])


def test_machine_learns_what_only_pairs_tell():
    """Two terms that are harmless alone and toxic together, and the other way round."""
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        noise = rng.integers(10, 60, 3)
        docs.append(np.unique([*[1] * int(a), *[2] * int(b), *noise.tolist()]))
        labels.append(int(a != b))
    machine = toxicity.fit(docs, np.array(labels), terms=64, epochs=60)
    places = {int(t): i for i, t in enumerate(machine.terms)}
    score = [machine.score([places[t] for t in d.tolist() if t in places]) for d in docs]
    assert ((np.array(score) > 0.5) == np.array(labels)).mean() > 0.97


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(3)
    machine = toxicity.Machine(np.arange(9), -1.0, rng.normal(size=9), rng.normal(size=(9, 4)))
    active = [0, 3, 4, 8]
    z = -1 + machine.weights[active].sum() + sum(
        machine.vectors[i] @ machine.vectors[j] for i in active for j in active if i < j)
    assert machine.score(active) == pytest.approx(1 / (1 + np.exp(-z)))
    again = toxicity.Machine.load(machine.dump())
    assert again.score(active) == machine.score(active)


def labels_of(spark, name):
    return {r.doc_id: r[name] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_held_out_toxicity(spark):
    rows = queries.op5_toxicity(spark, SF).collect()
    labels = labels_of(spark, "toxic")
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.3)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good = np.array([s for s, y in held if y == 0])
    bad = np.array([s for s, y in held if y == 1])
    assert (bad[:, None] > good[None, :]).mean() > 0.97
    assert (bad >= 0.3).mean() > 0.85 and (good >= 0.3).mean() < 0.01


def test_held_out_quality(spark):
    rows = queries.op10_quality(spark, SF).collect()
    labels = labels_of(spark, "quality")
    assert len(rows) == 10_000
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.doc_id in labels]
    passed = [r for r in held if not r.base_failed]
    assert np.mean([r.kept == (labels[r.doc_id] == 1) for r in passed]) > 0.98
    assert all(not r.kept for r in rows if r.base_failed)


def test_held_out_labels_are_never_learned(spark, documents):
    rows = [(i, f"text {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] + [(None, 1, 1)], LABELS)
    got = labelled.training_rows(documents(rows), labels, "toxic").collect()
    assert {r.doc_id for r in got} == {
        i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}
    few = labelled.training_rows(documents(rows), labels, "toxic", rows=40).count()
    assert few <= 60


def test_odd_rows_and_missing_labels(spark, documents):
    docs = documents(ODD_TEXTS, clash=True)
    none = spark.createDataFrame([], LABELS)
    machine = toxicity.train(docs, none)
    out = toxicity.score_documents(docs, machine).collect()
    assert len(out) == len(ODD_TEXTS) and {r.predicted for r in out} == {0}
    kept = toxicity.drop_toxic(docs, machine)
    assert kept.schema == docs.schema and kept.count() == len(ODD_TEXTS)
    trees = quality.train(docs, none)
    rows = quality.judge_documents(docs, trees).collect()
    assert len(rows) == len(ODD_TEXTS)
    assert {r.doc_id for r in rows if r.kept} == {7}
    one_sided = spark.createDataFrame([(2, 1, 0), (4, 1, 0)], LABELS)
    assert {r.predicted for r in toxicity.score_documents(
        docs, toxicity.train(docs, one_sided)).collect()} == {0}
    assert quality.judge_documents(documents([]), trees).collect() == []
    assert toxicity.score_documents(documents([]), machine).collect() == []


def test_filter_drops_toxic_rows_only(spark, documents):
    machine = toxicity.Machine(
        np.sort(np.array([toxicity.word_terms("vile")[0] * len(toxicity.LEVELS)])), -4.0,
        np.array([8.0]), np.zeros((1, 4)),
    )
    rows = [(1, "a vile thing"), (2, "a fine thing"), (3, None), (4, "VILE"), (4, "fine")]
    out = toxicity.drop_toxic(documents(rows), machine).collect()
    assert sorted((r.doc_id, r.text) for r in out if r.text) == [(2, "a fine thing"), (4, "fine")]
    assert 3 in {r.doc_id for r in out}


def test_pairs_are_learned_among_more_terms_than_any_cap():
    """At the parameters of the query; alone both terms tell nothing, and thousands tell more by chance."""
    rng = np.random.default_rng(4)

    def texts(n):
        docs, labels = [], []
        for _ in range(n):
            a, b = rng.random(2) < 0.5
            noise = rng.integers(100, 6100, 12)
            docs.append(np.unique([*[1] * int(a), *[2] * int(b), *noise.tolist()]))
            labels.append(int(a != b))
        return docs, np.array(labels)

    machine = toxicity.fit(*texts(6000))
    assert len(machine.terms) > 6000
    places = {int(t): i for i, t in enumerate(machine.terms)}
    docs, labels = texts(1000)
    score = [machine.score([places[t] for t in d.tolist() if t in places]) for d in docs]
    assert ((np.array(score) > 0.5) == labels).mean() > 0.95


def test_the_trees_of_the_query_fit_beyond_nine_tenths():
    """60 trees, as the query has; 30 trees reach 0.891 here, the best single cut 0.851."""
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = (x[:, 2] + 0.3 * np.sin(20 * x[:, 2]) + 0.2 * rng.random(3000) < 0.6).astype(float)
    assert ((quality.fit(x, y).score(x) > 0.5) == (y > 0)).mean() > 0.9
