import re

import duckdb
import numpy as np
import pytest

from rentatlas.llm import vertical

from .conftest import LONG, ODD_TEXTS


def by_hand(rows):
    """Components of all pairs of sets, one by one."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(words) < 4:
            sets.append({tuple(words)} if words else set())
        else:
            sets.append({tuple(words[i : i + 4]) for i in range(len(words) - 3)})
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                a, b = label[i], label[j]
                label = [min(a, b) if k in (a, b) else k for k in label]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if label[k] == label[i] and rows[k][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if sets[i] and ids else doc_id))
    return sorted(out, key=str)


def edited(rng, words, edits):
    words = list(words)
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = f"e{rng.integers(1 << 40)}"
    return " ".join(words)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def chains(seed=1):
    """Groups whose members lie around the threshold, chains, common passages, short texts."""
    rng = np.random.default_rng(seed)
    rows = []
    common = [f"c{i}" for i in range(60)]
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(20, 300)))]
        for _ in range(int(rng.integers(2, 14))):
            rows.append(edited(rng, base, int(rng.integers(0, 1 + len(base) // 40))))
        rows.append(" ".join(common + base[:30]))
    step = [f"s{i}" for i in range(400)]
    rows += [" ".join(step[k : k + 200]) for k in range(0, 200, 5)]
    rows += ["a b c", "A b C", "a b", "c b a", "x", "X", "x x", "a b c d", "a b c d a b c d", "é É", "É é"]
    return [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, documents, monkeypatch, small):
    if small:  # many blocks to a home, and blocks of a set or two
        monkeypatch.setattr(vertical, "BLOCK_SETS", 2)
    rows = chains() + [(1000 + (i or 0) if i else None, t) for i, t in ODD_TEXTS if t != LONG]
    rows += [(2000, LONG), (2001, LONG + " one more word"), (2000, LONG)]
    assert found(vertical.join_documents(documents(rows, clash=True))) == by_hand(rows)


def test_empty_table(spark, documents):
    assert vertical.join_documents(documents([])).collect() == []
    assert found(vertical.join_documents(documents([(4, None), (5, " ")]))) == [(4, 0, 4), (5, 0, 5)]


def test_hot_group_costs_rows_by_members(spark, documents):
    """600 near copies: links and rows of candidates stay in proportion, and nothing is lost."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, edited(rng, base, 2)) for i in range(600)] + [(600 + i, "same") for i in range(300)]
    _, links = vertical.link_sets(documents(rows))
    assert 0 < links.count() < 3 * 600
    assert found(vertical.join_documents(documents(rows))) == by_hand(rows)


def test_chance_meetings_cost_no_comparison(spark, documents, monkeypatch):
    """Texts put together from common passages share first shingles, but not enough to be compared whole."""
    kept = {}
    stage = vertical.stage
    monkeypatch.setattr(vertical, "stage", lambda df, name: kept.setdefault(name, stage(df, name)))
    rng = np.random.default_rng(4)
    passages = [" ".join(f"p{k}w{i}" for i in range(40)) for k in range(60)]
    rows = [
        (i, " ".join(passages[k] for k in rng.choice(60, rng.integers(6, 9), replace=False)))
        for i in range(200)
    ]
    rows += [(500 + i, rows[i][1] + " and one word more") for i in range(5)]
    assert found(vertical.join_documents(documents(rows))) == by_hand(rows)
    compared = kept["candidates"].selectExpr("sum(size(ids))").first()[0]
    assert 10 <= compared <= 100


def test_table_of_marks(spark):
    keys = [-(1 << 63), -1, 0, 1, 5 << 38, (1 << 63) - 1, 123456789 << 30]
    marks = vertical.marks_of(spark.createDataFrame([(k,) for k in keys + keys], "key long"))
    assert len(marks) == 1 << vertical.MARK_BITS - 3
    other = np.array([2 << 38, 9 << 50, -(9 << 50)], np.int64)
    assert vertical.marked(np.array(keys, np.int64), marks).all()
    assert not vertical.marked(other, marks).any()
    assert not vertical.marks_of(spark.createDataFrame([], "key long")).any()


def test_sql(spark, documents):
    rows = chains(2)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.execute(vertical.oracle_sql()).fetchall(), key=str) == by_hand(rows)


def test_fragments_are_even():
    rng = np.random.default_rng(1)
    table = rng.zipf(1.3, 1 << vertical.COUNTER_BITS).clip(0, 100_000)
    classes = vertical.classes_of(table)
    pivots = vertical.pivots_of(table, classes)
    assert (np.diff(pivots.astype(float)) > 0).all() and len(pivots) == vertical.FRAGMENTS - 1
    at = rng.choice(len(table), 200_000, p=table / table.sum()).astype(np.uint64)
    low = rng.integers(0, 1 << 42, len(at), dtype=np.uint64)
    shingles = (at << np.uint64(64 - vertical.COUNTER_BITS)) | low
    held = np.bincount(np.searchsorted(pivots, vertical.numbered(shingles, classes)), minlength=8)
    assert held.min() > 0.8 * held.mean() and held.max() < 1.2 * held.mean()


def test_overlaps():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3], [2, 3, 4], [], [9], [1, 2, 3, 4, 9])]
    xs, ys = np.triu_indices(5, 1)
    want = [len(set(sets[x].tolist()) & set(sets[y].tolist())) for x, y in zip(xs, ys, strict=True)]
    assert vertical.overlaps(sets, xs, ys).tolist() == want
