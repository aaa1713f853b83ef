import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rentatlas.llm import alignment
from rentatlas.llm.packing import tokenizer_path, visible_bytes
from rentatlas.llm.pieces import model_path

from .conftest import LONG, ODD_TEXTS


def by_hand(rows):
    """The contract with plain loops over the two original libraries."""
    import sentencepiece

    one = Tokenizer.from_file(tokenizer_path())
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=model_path())
    back = {chr(c): b for b, c in visible_bytes().items()}
    token_bytes = lambda i: bytes(back[c] for c in one.id_to_token(i))

    def piece_bytes(i):
        piece = two.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode()

    documents, counts = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        a = one.encode(" " + text, add_special_tokens=False).ids
        b = two.encode(text)
        raw = b" " + text.encode()
        sizes_a, sizes_b = ([len(f(i)) for i in x] for f, x in ((token_bytes, a), (piece_bytes, b)))
        if not text or b"".join(map(token_bytes, a)) != raw or b"".join(map(piece_bytes, b)) != raw:
            documents.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum(sizes_a).tolist(), np.cumsum(sizes_b).tolist()
        links = [
            (x, y)
            for x, ex, sx in zip(a, ends_a, sizes_a, strict=True)
            for y, ey, sy in zip(b, ends_b, sizes_b, strict=True)
            if max(ex - sx, ey - sy) < min(ex, ey)
        ]
        groups, start = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(tuple(
                [i for i, e in zip(x, ends, strict=True) if start < e <= end]
                for x, ends in ((a, ends_a), (b, ends_b))
            ))
            start = end
        counts.update(links)
        documents.append((doc_id, a, b, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, a, b, groups, links in documents:
        shown = ";".join(
            ",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups
        )
        out.append((
            doc_id, len(a), len(b), len(groups), len(links),
            sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(shown.encode()).hexdigest() if shown else "",
        ))
    return sorted(out, key=str)


TEXTS = [(i, t) for i, t in ODD_TEXTS if t != LONG] + [
    (100 + i, t)
    for i, t in enumerate([
        LONG[:900], " leading", "trailing  ", "two  spaces   three", "a▁b", "<|endoftext|> <s> x",
        "don't we'll 12345 $$$ ###", "tab\tline\nnew\r\n", "ﬁne ① ½", " odd spaces",
        "x" * 400, "日本語のテキスト", "the the the the", "é é", "\x00\x01", "<0x0A>",
    ])
]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("limit", "shard_pairs"), [(4_000_000, 1 << 20), (300, 40)])
def test_against_loops(spark, documents, limit, shard_pairs):
    df = documents(TEXTS, clash=True)
    got = found(alignment.align_documents(df, limit=limit, shard_pairs=shard_pairs))
    assert got == by_hand(TEXTS)
    assert sum(r[1] == 0 for r in got) >= 3


def test_empty_table(spark, documents):
    assert alignment.align_documents(documents([])).collect() == []
    assert [tuple(r)[1:] for r in alignment.align_documents(documents([(1, None)])).collect()] == [
        (0, 0, 0, 0, 0, 0, "")
    ]


def test_fast_ids_are_the_tokenizers():
    pair = alignment.tokenizers(tokenizer_path(), model_path())
    for text in [t for _, t in TEXTS if t] + [LONG[:50_000], "a" * 5_000, " " * 3_000 + "b"]:
        text = " " + text
        assert pair.ids_a(text) == pair.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 60, n))
    made = alignment.PerfectHash.loads(alignment.PerfectHash.of(keys).dumps())
    assert made.n == len(keys)
    assert sorted(made(keys).tolist()) == list(range(len(keys)))
    if n == 100_000:
        assert len(made.dumps()) * 8 / n < 4.5


def test_a_pair_no_document_holds_fails(spark):
    keys = np.array([5, 6, 7], np.int64)
    slots = alignment.PerfectHash.of(keys)
    by_slot = np.empty(3, np.int64)
    by_slot[slots(keys)] = keys
    index = spark.createDataFrame(
        [(0, bytearray(slots.dumps()), bytearray(by_slot.tobytes()), bytearray(keys.tobytes()))],
        "shard long, hash binary, keys binary, vector binary",
    )
    rows = "shard long, leaf int, block long, pairs binary, counts binary"
    good = spark.createDataFrame([(0, 1, 9, bytearray(keys.tobytes()), None)], rows)
    assert alignment.looked_up(good, index).count() == 1
    bad = spark.createDataFrame([(0, 1, 9, bytearray(np.array([8]).tobytes()), None)], rows)
    with pytest.raises(Exception, match="no document holds"):
        alignment.looked_up(bad, index).collect()


def test_links_of_crossing_tokens():
    class Sizes:
        size_a, size_b = np.array([0, 1, 2, 3]), np.array([0, 1, 2, 3])

    got = alignment.align(
        Sizes, np.array([2, 2, 1], "<u4"), np.array([1, 3, 1], "<u4"), np.array([2, 1])
    )
    assert [(int(x) >> 32, int(x) & 255) for x in got.links] == [(2, 1), (2, 3), (2, 3), (1, 1)]
    assert got.n_links.tolist() == [3, 1] and got.n_groups.tolist() == [1, 1]
    assert pa.array(got.group_a).to_pylist() == [0, 0, 1]
