import hashlib

import duckdb
import pytest

from rentatlas.llm import infill

from .conftest import LONG, ODD_TEXTS


def plain_way(doc_id, text):
    """The contract, word by word, over a whole string."""
    text = text or ""
    n = len(text)
    seen = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(seen[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = []
    for doc_id, text in rows:
        n, form, prefix, middle, output = plain_way(doc_id, text)
        out.append((doc_id, n, form, prefix, middle, sha(output), sha(text or "")))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


TEXTS = ODD_TEXTS + [
    (i, t)
    for i, t in enumerate(
        ["<P>", "a<S>b", "x<M", "<<P", "P><S", "<", "é" * 5, "😀a" * 40, "ab\r\n" * 33] * 12, 100
    )
]


@pytest.mark.parametrize("units", [1, 7, 16_384])
def test_against_whole_strings(spark, documents, units):
    rows = [(i, t) for i, t in TEXTS if units > 1 or len(t or "") < 500]
    stored = infill.store(documents(rows, clash=True), units)
    outputs = infill.transform(stored)
    assert found(infill.digests(outputs)) == expected(rows)
    forms = {r[2] for r in expected(rows)}
    assert forms == {"plain", "psm", "spm"}
    texts = sorted((r.doc_id, r.form, r.output) for r in infill.texts(outputs).collect() if r.doc_id)
    assert texts == sorted(
        (i, plain_way(i, t)[1], plain_way(i, t)[4]) for i, t in rows if i is not None
    )


def test_empty_table(spark, documents):
    assert infill.digests(infill.transform(infill.store(documents([])))).collect() == []


def test_only_cut_frames_are_read(monkeypatch):
    codec = infill.Codec()
    text = codec.frames(LONG, 1000)
    read = []
    raw = infill.Frames.raw
    monkeypatch.setattr(infill.Frames, "raw", lambda self, k: read.append(k) or raw(self, k))
    out = infill.rearranged(text, "psm", 12_345, 345_678)
    assert sorted(set(read)) == [12, 345]
    assert sum(f in set(text.frames) for f in out.frames) == len(text.frames) - 2


def test_marks_across_frames():
    codec = infill.Codec()
    for units in (1, 2, 3, 4, 5):
        output = codec.frames("<P>a<<S<S>b><M>", units)
        assert output.find(["<P>", "<S>", "<M>"]) == [0, 7, 12]
        assert output.find(["<M>", "<S>"]) == [12, -1]


def test_sql(spark, documents):
    rows = [r for r in TEXTS if r[0] is not None]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.execute(infill.oracle_sql()).fetchall(), key=str) == expected(rows)
