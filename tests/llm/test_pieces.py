import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from llm.conftest import ODD_TEXTS

from rentatlas.llm import pieces

PATH = pieces.model_path()


def test_parity_with_the_original_library():
    rng = random.Random(2)
    bits = ["a", "bc", "é", " ", "  ", "\n", "▁", "日", "😀", ".", "the", "\t", " the", " ", "<s>",
            "<unk>", "<0x41>", "\x00", "é", "ﬁ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(16))) for _ in range(10_000)]
    assert pieces.parity(PATH, texts + [t or "" for _, t in ODD_TEXTS]) == []


def test_whole_texts_and_remembered_words_agree():
    own = pieces.Codec(PATH, limit=4_000)
    texts = ["some words and some more words", "words", "a  b", ""] * 50
    for at in range(0, 200, 30):
        some = texts[at : at + 30]
        assert [i.tolist() for i in own.encode(pa.array(some))] == [
            i.tolist() for i in own.encode_whole(some)]
        assert [own.decode(i) for i in own.encode(pa.array(some))] == [
            own.tokenizer.decode(i.tolist(), skip_special_tokens=False)
            for i in own.encode_whole(some)]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + np.float32(value).tobytes()
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_unigram_models_are_rebuilt_from_their_scores(tmp_path):
    """A model written by hand, read by both libraries."""
    normal = [("▁", -3.0), ("a", -2.0), ("b", -2.1), ("ab", -2.5), ("▁a", -2.4), ("▁ab", -3.2),
              ("ba", -2.6), ("c", -5.0), ("abc", -7.5)]
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    rows += [(p, s, 1) for p, s in normal]
    data = b"".join(
        message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in rows)
    data += message((2, message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2))))
    data += message((3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    path = tmp_path / "own.model"
    path.write_bytes(data)
    model = pieces.read_model(data)
    assert model.kind == pieces.UNIGRAM and model.byte_fallback and not model.squeeze
    assert model.pieces[259:] == [p for p, _ in normal]
    sentencepiece.SentencePieceProcessor(model_file=str(path))
    rng = random.Random(3)
    texts = ["".join(rng.choice("aabbc éx") for _ in range(rng.randrange(20))) for _ in range(2000)]
    assert pieces.parity(str(path), texts) == []


def test_query_columns(spark, documents):
    original = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [*ODD_TEXTS, (60, "rare 𓀀 signs 𒀀")]
    out = pieces.encode_documents(documents(rows, clash=True), with_ids=True).collect()
    expected = {}
    for i, text in rows:
        ids = original.encode(text or "")
        expected.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()),
                                           ids))
    for r in out:
        assert (r.n_ids, r.ids_crc32, r.ids) in expected[r.doc_id]
        assert r.round_trip and r.n_unknown == 0
    assert len(out) == len(rows)
    assert next(r for r in out if r.doc_id == 60).n_byte_ids == 8
    assert pieces.encode_documents(documents([])).collect() == []


def test_decoding_frames(spark, documents):
    rows = [(1, "héllo  wörld 😀"), (2, " led by a space"), (3, ""), (4, None)]
    ids = pieces.encode_documents(documents(rows), with_ids=True).select("doc_id", "ids")
    back = {r.doc_id: r.text for r in pieces.decode_ids(ids).collect()}
    assert back == {1: "héllo  wörld 😀", 2: " led by a space", 3: "", 4: ""}
    missing = spark.createDataFrame([(9, None)], "doc_id long, ids array<int>")
    assert pieces.decode_ids(missing).first().text == ""


def test_wire_format_errors():
    with pytest.raises(ValueError, match="wire type"):
        list(pieces.wire_fields(b"\x0b"))
    with pytest.raises(ValueError, match="unigram and pair"):
        pieces.read_model(message((2, message((3, 4)))))
