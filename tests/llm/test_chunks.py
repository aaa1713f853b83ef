import random

from llm.conftest import LONG, ODD_TEXTS
from pyspark.sql import functions as F

from rentatlas.llm import chunks


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
                    for _ in range(n))


def test_chunks_rebuild_the_text_and_do_not_depend_on_the_block():
    rng = random.Random(5)
    texts = [words(rng, 300), "é" * 3000, "", " ", "a" * 2000, "日本" * 900, words(rng, 5), LONG]
    together = chunks.cut(texts)
    for i, text in enumerate(texts):
        alone = chunks.cut([text])
        raw = text.encode()
        parts = [raw[a:b] for a, b in zip(alone.start.tolist(), alone.end.tolist(), strict=True)]
        assert b"".join(parts) == raw and all(p.decode() for p in parts)
        mine = together.doc == i
        base = together.start[mine].min() if mine.any() else 0
        assert (together.end[mine] - base).tolist() == alone.end.tolist()
        assert all(len(p) <= chunks.MAX_BYTES + 3 for p in parts if b" " not in p)


def test_an_insertion_changes_few_chunks():
    text = words(random.Random(6), 2000)
    before = set(chunks.cut([text]).digests())
    after = chunks.cut([text[:4000] + " inserted words " + text[4000:]]).digests()
    assert sum(d not in before for d in after) <= 6


def passages(rng):
    """Texts of which every third holds one of two passages of 60 words."""
    shared = [words(rng, 60), words(rng, 60)]
    rows = []
    for i in range(60):
        own = words(rng, 120).split()
        if i % 3 == 0:
            own[40:40] = shared[i % 2].split()
        if i % 2:
            own[5:5] = "one short line of boilerplate that is in many".split()
        rows.append((i, " ".join(own)))
    return rows, shared


def windows(text, n=45):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_repeated_passages_go_from_all_texts_but_one(spark, documents):
    rows, shared = passages(random.Random(8))
    out = {r.doc_id: r for r in chunks.find_repeats(documents(rows, clash=True)).collect()}
    assert set(out) == {i for i, _ in rows}
    for passage in shared:
        holders = [i for i, t in rows if passage in t]
        whole = [i for i in holders if windows(passage) & windows(out[i].text)]
        assert len(holders) == 10 and len(whole) == 1 and out[whole[0]].n_kept > 150
    for i, text in rows:
        r = out[i]
        ranges = [tuple(map(int, s.split(":"))) for s in r.dropped.split(",") if s]
        rest = "".join(text[a:b] for a, b in zip([0, *[e for _, e in ranges]],
                                                 [*[s for s, _ in ranges], len(text)],
                                                 strict=True))
        assert r.text == rest and r.n_dropped == sum(b - a for a, b in ranges)
        if i % 3:
            assert r.text == text  # boilerplate alone is no passage


def test_agrees_with_digests_counted_in_plain_python(spark, documents):
    rows, _ = passages(random.Random(9))
    held = {}
    keys = {r.doc_id: r.key for r in documents(rows).select(
        "doc_id", chunks.row_key().alias("key")).collect()}
    for i, t in rows:
        for digest in chunks.cut([t]).digests():
            held.setdefault(digest, set()).add(keys[i])
    expected = {}
    for i, t in rows:
        for place, digest in enumerate(chunks.cut([t]).digests()):
            if len(held[digest]) > 1:
                expected.setdefault(keys[i], set()).add((place, keys[i] == min(held[digest])))
    found = {r.row_key: {(h.place, h.kept) for h in r.hits}
             for r in chunks.repeated_chunks(documents(rows)).collect()}
    assert found == expected


def test_odd_rows(spark, documents):
    twice = ODD_TEXTS + [(70, LONG)]
    df = documents(twice, clash=True)
    out = chunks.drop_repeats(df)
    assert out.schema == df.schema and out.count() == len(twice)
    rows = out.collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    long = sorted(len(r.text) for r in rows if r.doc_id in (7, 70))
    assert long == [0, len(LONG)]  # one of two whole copies keeps everything
    same = [r.text for r in rows if r.doc_id == 8]
    assert sorted(same) == ["other", "same text", "same text"]
    assert {r.row for r in rows} == {"kept"}
    assert chunks.drop_repeats(documents([])).collect() == []
    assert chunks.find_repeats(documents([(1, None)])).collect()[0].text is None


def test_hot_chunk(spark, documents):
    text = words(random.Random(4), 50)
    out = chunks.drop_repeats(documents([(i, text) for i in range(2000)]))
    assert out.where(F.col("n_chars") > 0).count() == 1


ALPHABETS = {
    "chinese": [chr(c) for c in range(0x4E00, 0x5400)],
    "japanese": [chr(c) for c in [*range(0x3041, 0x3097), *range(0x4E00, 0x4F00)]],
    "thai": [chr(c) for c in range(0x0E01, 0x0E2F)],
    "minified": list("abcdefghijklmnopqrstuvwxyz0123456789(){}[];,.=+!&|"),
}


def unspaced(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


def test_equal_texts_without_white_space_go_but_one(spark, documents):
    rng = random.Random(11)
    texts = {name: unspaced(rng, letters, 2000) for name, letters in ALPHABETS.items()}
    rows = [(10 * i + k, t) for i, t in enumerate(texts.values()) for k in range(2)]
    out = {r.doc_id: r for r in chunks.find_repeats(documents(rows)).collect()}
    for i, text in enumerate(texts.values()):
        pair = [out[10 * i].text, out[10 * i + 1].text]
        assert sorted(pair) == ["", text]


def test_passages_without_white_space_go_but_one(spark, documents):
    rng = random.Random(12)
    for letters in ALPHABETS.values():
        shared = unspaced(rng, letters, 1200)
        rows = []
        for i in range(6):
            own = unspaced(rng, letters, 900)
            at = rng.randrange(900)
            rows.append((i, own[:at] + shared + own[at:]))
        out = chunks.find_repeats(documents(rows)).collect()
        assert sum(r.n_dropped == 0 for r in out) == 1
        assert all(1000 <= r.n_dropped <= 1200 for r in out if r.n_dropped)
        rest = dict(rows)
        for r in out:
            ranges = [tuple(map(int, x.split(":"))) for x in r.dropped.split(",") if x]
            assert all(rest[r.doc_id][a:b] in shared for a, b in ranges)


def test_an_insertion_without_white_space_changes_few_chunks():
    rng = random.Random(13)
    for letters in ALPHABETS.values():
        text = unspaced(rng, letters, 6000)
        before = set(chunks.cut([text]).digests())
        after = chunks.cut([text[:2000] + letters[3] + text[2000:]]).digests()
        assert len(after) > 20 and sum(d not in before for d in after) <= 4


def test_short_repeats_without_white_space_stay(spark, documents):
    rng = random.Random(14)
    letters = ALPHABETS["chinese"]
    shared = unspaced(rng, letters, 60)
    rows = [(i, unspaced(rng, letters, 500) + shared + unspaced(rng, letters, 500))
            for i in range(5)]
    assert all(r.n_dropped == 0 for r in chunks.find_repeats(documents(rows)).collect())


def test_equal_rows_share_their_hits(spark, documents):
    text = words(random.Random(21), 300)
    docs = documents([(1, text)] * 5000 + [(2, text)])
    hits = chunks.repeated_chunks(docs).select(F.size("hits").alias("n")).collect()
    n = len(chunks.cut([text]).start)
    assert [r.n for r in hits] == [n, n]
    out = chunks.find_repeats(docs).groupBy("doc_id", "n_dropped", "text").count().collect()
    assert sorted((r.doc_id, r["count"]) for r in out) == [(1, 5000), (2, 1)]
    assert sorted(r.text for r in out) == ["", text]
