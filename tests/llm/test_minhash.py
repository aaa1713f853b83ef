import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm.conftest import LONG, ODD_TEXTS

from rentatlas.llm import minhash


def prose(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n)]


def shingles(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows, least=0.8):
    """Components of the texts whose weighted Jaccard similarity is at least ``least``."""
    texts = sorted({t or "" for _, t in rows})
    sets = {t: shingles(t) for t in texts}
    n, seen = len(rows), Counter()
    for _, t in rows:
        seen.update(sets[t or ""].keys())
    floor = max(2, math.ceil(minhash.RARE * n))

    def idf(s):
        if seen[s] < floor:
            return 2.0
        share = max(seen[s] / n, minhash.RARE)
        return 1 + math.log(1 / share) / math.log(1 / minhash.RARE)

    total = {t: sum(idf(s) * k for s, k in sets[t].items()) for t in texts}
    top = {t: t for t in texts}

    def root(t):
        while top[t] != t:
            t = top[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            small, large = sorted((sets[a], sets[b]), key=len)
            both = sum(idf(s) * min(k, large[s]) for s, k in small.items() if s in large)
            if both and both >= least * (total[a] + total[b] - both) - 1e-9:
                top[root(a)] = root(b)
    out = {}
    for i, t in rows:
        out.setdefault(root(t or ""), []).append(i)
    return sorted(sorted(map(str, ids)) for ids in out.values())


def found_classes(rows, out):
    held = {}
    for r in out:
        held.setdefault((r.class_id, r.n_class), []).append(r.doc_id)
    for (_, n), ids in held.items():
        assert len(ids) == n
    return sorted(sorted(map(str, ids)) for ids in held.values())


def edited(rng, words, share):
    return [rng.choice(["xx", "yy", "zz"]) + w if rng.random() < share else w for w in words]


def corpus(rng):
    boiler = prose(rng, 12)
    rows = []
    for g in range(30):
        base = prose(rng, rng.randrange(30, 250)) + (boiler if g % 3 == 0 else [])
        rows += [" ".join(base)] * (1 + g % 2)
        rows += [" ".join(edited(rng, base, s)) for s in (0.005, 0.01, 0.03, 0.1)]
    rows += [" ".join(boiler), "", "", None, "a", "a b", "a b", " a  b ", "a b a b a b a b a b a b"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_classes_are_those_of_brute_force(spark, documents):
    rows = corpus(random.Random(7))
    out = minhash.near_duplicates(documents(rows, clash=True)).collect()
    assert len(out) == len(rows)
    assert found_classes(rows, out) == brute_classes(rows)
    for r in out:
        assert r.kept == (r.doc_id == r.class_id)


def test_large_groups_compared_in_blocks(spark, documents, monkeypatch):
    """A group of near copies dealt out over many blocks, none of them a chain by chance."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 16)
    rng = random.Random(3)
    base = prose(rng, 80)
    rows = list(enumerate([" ".join(edited(rng, base, 0.02)) for _ in range(150)]))
    out = minhash.near_duplicates(documents(rows)).collect()
    assert found_classes(rows, out) == brute_classes(rows)


def test_frequent_shingles_are_counted_exactly(spark, documents, monkeypatch):
    monkeypatch.setattr(minhash, "COUNTER_BITS", 17)
    rng = random.Random(5)
    shared = [prose(rng, 5) for _ in range(20)]
    rows = []
    for i in range(300):
        w = prose(rng, 10)
        for k, s in enumerate(shared):
            if i % (k + 2) == 0:
                w += s
        rows.append((i, " ".join(w)))
    found = [
        minhash.frequent_shingles(documents(rows).repartition(n), share=0.05) for n in (1, 32, 211)
    ]
    for other in found[1:]:
        assert [x.tolist() for x in other[:2]] == [x.tolist() for x in found[0][:2]]
    got, counts, total = found[0]
    seen = Counter()
    for _, t in rows:
        seen.update(set(minhash.shingled(pa.array([t])).shingle.tolist()))
    expected = {s: n for s, n in seen.items() if n >= math.ceil(0.05 * 300)}
    assert dict(zip(got.tolist(), counts.tolist(), strict=True)) == expected and total == 300


def test_samples_agree_as_often_as_the_weighted_similarity():
    """Share of equal samples against the exact similarity of two weighted sets."""
    rng = np.random.default_rng(1)
    for overlap in (0.2, 0.5, 0.8, 0.95):
        both = rng.integers(0, 1 << 48, 400, dtype=np.uint64)
        cut = int(400 * overlap)
        a = np.unique(both)
        b = np.unique(np.concatenate([both[:cut], rng.integers(0, 1 << 48, 400 - cut,
                                                              dtype=np.uint64)]))
        weight = {int(s): float(w) for s, w in zip(a, rng.gamma(2, 1, len(a)), strict=True)}
        wb = {int(s): weight.get(int(s), 1.0) * (1.5 if i % 3 == 0 else 1.0)
              for i, s in enumerate(b)}
        keys = set(weight) | set(wb)
        exact = sum(min(weight.get(k, 0), wb.get(k, 0)) for k in keys) / sum(
            max(weight.get(k, 0), wb.get(k, 0)) for k in keys)
        block = minhash.Shingled(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]),
                                 np.ones(len(a) + len(b), np.int64), 2)
        values = np.array([weight[int(s)] for s in a] + [wb[int(s)] for s in b])
        samples = minhash.Sampler(2000)(block, values)
        assert (samples[0] == samples[1]).mean() == pytest.approx(exact, abs=0.04)


def test_similarity_matrix_is_exact():
    rng = random.Random(9)
    base = prose(rng, 60)
    texts = [" ".join(edited(rng, base, rng.random() * 0.1)) for _ in range(40)] + [
        "a b a b a b a b", "a b a b a b a b a b", "", "x"]
    block = minhash.shingled(pa.array(texts))
    idf = 1 + (block.shingle % np.uint64(100)).astype(float) / 100
    value = {int(s): v for s, v in zip(block.shingle, idf, strict=True)}
    bounds = block.bounds()
    held = [dict(zip(block.shingle[a:b].tolist(), block.times[a:b].tolist(), strict=True))
            for a, b in zip(bounds, bounds[1:], strict=False)]
    matrix = minhash.similar(block, block.times * idf, idf, 0.5)
    for i, p in enumerate(held):
        for j, q in enumerate(held):
            if i == j:
                continue
            both = sum(value[s] * min(k, q.get(s, 0)) for s, k in p.items())
            either = sum(value[s] * k for s, k in (*p.items(), *q.items())) - both
            assert matrix[i, j] == (both > 0 and both >= 0.5 * either - 1e-6)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(50)] + [(100 + rng.randrange(40), 100) for _ in range(60)]
    edges += [(1000 - i, 999 - i) for i in range(30)] + [(7, 7)]
    df = spark.createDataFrame([(str(a).zfill(5), str(b).zfill(5)) for a, b in edges],
                               "a string, b string")
    held = {}
    for r in minhash.components(df).collect():
        held.setdefault(r.label, set()).add(int(r.node))
    sizes = sorted(map(len, held.values()))
    assert sizes == sorted([51, len({a for a, _ in edges[50:110]} | {100}), 31])


def test_odd_rows_and_filter(spark, documents):
    near = LONG.replace("word5x5 ", "other ")
    rows = ODD_TEXTS + [(70, near), (71, "same  text\n")]
    df = documents(rows, clash=True)
    out = minhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    assert found_classes(rows, out) == brute_classes(rows)
    kept = minhash.drop_near_duplicates(df)
    assert kept.schema == df.schema
    left = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [x[:2] for x in left] == [(False, i) for i in (1, 3, 4, 5, 6, 7, 8, 8)] + [(True, 0)]
    assert minhash.drop_near_duplicates(documents([])).collect() == []
    assert minhash.near_duplicates(documents([])).collect() == []


def test_hot_copies(spark, documents):
    rows = [(i, "the very same text in many rows of the table") for i in range(3000)]
    rows += [(9000 + i, f"another text number {i} that is not like the others at all {i}")
             for i in range(50)]
    assert minhash.drop_near_duplicates(documents(rows)).count() == 51


def test_columns_named_like_work_columns_stay(spark, documents):
    df = documents([(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words here")], clash=True)
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in df.where("doc_id <> 2").collect()}
