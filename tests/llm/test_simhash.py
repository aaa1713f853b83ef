import hashlib
import random

from llm.conftest import LONG, ODD_TEXTS
from pyspark.sql import functions as F

from rentatlas.llm import simhash


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
                    for _ in range(n))


def apart(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_neighbours_edits_and_likeness(spark, documents, monkeypatch):
    """Every column against plain Python, over many buckets and over ids far apart."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 7)
    rng = random.Random(1)
    ids = rng.sample(range(10_000), 80) + [-5, 10**15]
    rows = [(i, prose(rng, rng.randrange(0, 200)) + rng.choice(["", " é日😀"])) for i in ids]
    out = {r.doc_id: r for r in simhash.compare_neighbours(documents(rows, clash=True)).collect()}
    order = sorted(rows, reverse=True)
    assert len(out) == len(rows)
    for (i, text), (j, following) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = out[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == 1 - apart(r.fingerprint, r.edited_fingerprint) / 128
        assert r.near_next == 1 - apart(r.fingerprint, out[j].fingerprint) / 128
    long = [r for r in out.values() if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)


def test_fingerprint_is_the_weighted_vote_of_all_terms(spark):
    """The sums of packed counters against single bits of the same hashes."""
    texts = ["a b c d e f g a b c d e f g", "one two", "", LONG[:9000]]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: (r.f0, r.f1) for r in simhash.fingerprints(df, ["k"]).collect()}
    words = df.select("k", simhash.term_hashes(F.col("text")).alias("words"))
    hashed = words.select("k", simhash.windows(F.col("words")).alias("h"))
    for r in hashed.select("k", F.explode("h").alias("h")).withColumn(
        "g", F.xxhash64("h", F.lit(1))
    ).groupBy("k").agg(F.collect_list("h").alias("h"), F.collect_list("g").alias("g")).collect():
        for part, held in ((0, r.h), (1, r.g)):
            bits = 0
            for i in range(64):
                ones = sum((x >> i) & 1 for x in held)
                bits |= (2 * ones > len(held)) << i
            assert bits == got[r.k][part] & ((1 << 64) - 1)


def test_equal_texts_have_equal_fingerprints_and_odd_rows_work(spark, documents):
    out = simhash.compare_neighbours(documents(ODD_TEXTS)).collect()
    assert len(out) == len(ODD_TEXTS)
    empty = {r.fingerprint for r in out if r.doc_id in (1, 2)}
    assert len(empty) == 1
    same = [r.fingerprint for r in out if r.doc_id == 8]
    assert len(set(same)) == 2
    assert simhash.compare_neighbours(documents([])).collect() == []
    one = simhash.compare_neighbours(documents([(4, "just one row here")])).collect()[0]
    assert one.near_next == 1.0
    last = next(r for r in out if r.doc_id is None)
    assert last.n_chars == len("without an id")


def test_no_python_runs(spark, documents):
    plan = simhash.compare_neighbours(documents([(1, "a"), (2, "b")]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(4)
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(40)]
    prints = list(base)
    for f0, f1 in base:
        for k in range(1, 7):
            bits = rng.sample(range(128), k)
            a, b = f0, f1
            for bit in bits:
                a, b = (a ^ (1 << bit), b) if bit < 64 else (a, b ^ (1 << (bit - 64)))
            prints.append((a, b))
    prints += base[:5] * 3

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in prints], "f0 long, f1 long")
    for radius in (0, 3, 5):
        found = {(r.q0, r.q1, r.f0, r.f1): (r.distance, r.rows)
                 for r in simhash.find_near(df, df.limit(30), radius).collect()}
        expected = {}
        for qa, qb in set(prints[:30]):
            for a, b in set(prints):
                d = (qa ^ a).bit_count() + (qb ^ b).bit_count()
                if d <= radius:
                    key = tuple(map(signed, (qa, qb, a, b)))
                    expected[key] = (d, prints.count((a, b)))
        assert found == expected
