import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm.conftest import ODD_TEXTS
from tokenizers import Tokenizer

from rentatlas.llm import packing

PATH = packing.tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_remembered_parts_give_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(3)
    bits = ["a", "bc", "é", " ", "  ", "\n", "\n\n", ".", ",", "!!", "'s", "'", "1", "22", " the",
            "\t", "日", "<|endoftext|>", "%%%", "_", " ", "ll"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(6000)]
    encode = packing.CachedEncoder(PATH, limit=10_000)
    for at in range(0, len(texts), 700):
        some = texts[at : at + 700]
        whole = [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)]
        own = [np.frombuffer(b, "<u4").tolist() for b in encode(pa.array(some))]
        assert own == whole


def same_ids(encode, texts, tokenizer):
    whole = tokenizer.encode_batch(texts, add_special_tokens=False)
    found = encode(pa.array(texts, pa.string()))
    return [np.frombuffer(f, "<u4").tolist() for f in found] == [w.ids for w in whole]


def test_only_texts_with_an_added_token_are_encoded_whole(tokenizer, monkeypatch):
    encode, sent = packing.CachedEncoder(PATH), []
    whole = encode._whole
    monkeypatch.setattr(encode, "_whole", lambda texts: sent.extend(texts) or whole(texts))
    texts = ["two  spaces", "line \n\n here ", "one<|endoftext|>two", "", " ", "last"]
    assert same_ids(encode, texts, tokenizer)
    assert sent == ["one<|endoftext|>two"]


def test_words_are_cut_as_the_tokenizer_cuts_them(tokenizer):
    rng = random.Random(5)
    bits = ["a", "é", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "v", "e", "l", "S", "!", "7", "½",
            "\x85", "\x1c", "\u00a0", "\u2009", "\u200b", "\u3000", "\u0301", "\u0663", "日", "😀", "\0"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(8000)]
    texts += ["", "'", "s", "'r", "e", "a'l", "l", " ", "b"]  # texts do not run on into the next
    texts += ["".join(chr(rng.randrange(0xD800)) for _ in range(20)) for _ in range(300)]
    assert same_ids(packing.CachedEncoder(PATH), texts, tokenizer)


def test_long_text_in_windows(tokenizer):
    text = " ".join(f"we'll  {i}\nsee word, and more" for i in range(500))
    parts = list(packing.windows(text, 700))
    assert "".join(parts) == text and len(parts) > 15 and max(map(len, parts)) < 760
    found = b"".join(packing.CachedEncoder(PATH)(pa.array(parts)))
    whole = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(found, "<u4").tolist() == whole
    assert list(packing.windows("x" * 2000, 700)) == ["x" * 2000] and list(packing.windows("")) == [""]


def test_words_that_are_mostly_rare_take_less_time_than_the_whole_text(tokenizer):
    rng = random.Random(7)
    syllables = "th he an in er on re ed nd ha at en es of or nt ea ti to it st io le is ou".split()
    texts = [" ".join("".join(rng.choices(syllables, k=rng.randrange(1, 6))) + rng.choice(["", "", ".", ",", ".\nA"])
                      for _ in range(300)) for _ in range(1500)]
    column = pa.array(texts)
    encode = packing.CachedEncoder(PATH)
    encode(column.slice(0, 10))
    start = time.process_time()
    for at in range(0, len(texts), 500):
        encode(column.slice(at, 500))
    own = time.process_time() - start
    start = time.process_time()
    tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert own < 0.7 * (time.process_time() - start)


@pytest.mark.parametrize("n", [0, 1, 7, 400, 30_000])
def test_plan_uses_every_piece_once(n):
    rng = np.random.default_rng(n)
    counts = Counter(rng.integers(1, 1025, n).tolist())
    plan = packing.plan_sequences(dict(counts), 1024)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 1024 and times > 0
        for x in lengths:
            used[x] += times
    assert used == counts
    total = sum(x * k for x, k in counts.items())
    least = max(-(-total // 1024), sum(k for x, k in counts.items() if x > 512))
    assert sum(k for _, k in plan) <= least * 1.02 + 2


def test_gaps_are_filled_by_pairs_and_triples_first():
    # 600 leaves 424 = 300 + 124 exactly, though 400 would be the best single fit.
    assert packing.plan_sequences({600: 1, 400: 1, 300: 1, 124: 1}, 1024)[0] == (
        [600, 300, 124], 1)
    assert packing.plan_sequences({600: 2, 200: 2, 150: 2, 74: 2, 423: 2}, 1024)[0] == (
        [600, 200, 150, 74], 2)


def test_documents(spark, documents, tokenizer):
    rng = random.Random(1)
    rows = [(i + 10, " ".join(rng.choice(["alpha", "beta", "gamma,"]) for _ in range(
        rng.randrange(1, 1500)))) for i in range(60)] + ODD_TEXTS
    out = packing.pack_documents(documents(rows, clash=True)).collect()
    ids = {}
    for i, text in rows:
        found = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        ids.setdefault(i, []).append(found)
    pieces = Counter()
    for key, lists in ids.items():
        for found in lists:
            for k, (s, n) in enumerate(packing.cut_lengths(len(found), 1024)):
                crc = zlib.crc32(np.array(found[s : s + n], "<u4").tobytes())
                pieces[key, k, s, n, crc] += 1
                assert n == 1024 or k == 0
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 1024


def test_hot_length_and_empty_table(spark, documents):
    out = packing.pack_documents(documents([(i, "tie") for i in range(3000)]))
    rows = out.collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3000
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) == -(-total // 1024)
    assert packing.pack_documents(documents([])).collect() == []


def test_memories_are_bounded_by_bytes(tokenizer):
    encode = packing.CachedEncoder(PATH, limit=100_000)
    texts = [f"x {'ab' * 1000}{i} short{i}" for i in range(2_000)]
    found = encode(pa.array(texts))
    whole = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [w.ids for w in whole]
    for memory in (encode.parts, encode.words):
        held = [*memory.young.items(), *memory.old.items()]
        assert all(len(k) <= packing.LONGEST_REMEMBERED for k, _ in held)
        assert sum(packing.ENTRY_BYTES + len(k) + len(v) for k, v in held) < 210_000
