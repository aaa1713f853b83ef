"""SentencePiece encoding and decoding on the tokenizers library.

A model file is a protobuf; its pieces, scores and settings are read from the wire format and a
tokenizer of the other library is rebuilt from them: normaliser, metaspace marker, unigram scores or
pair merges, byte fallback. ``parity`` compares it with the original library text by text.

Where no piece of the vocabulary has a marker behind another character, words never meet in a piece,
so a worker remembers the ids of each word. Other vocabularies, and texts that the normaliser
changes, are encoded whole, in batches and with the library's threads.

Defined results: a missing text is an empty one and has no ids; repeated rows repeat their result; an
empty table yields no rows; texts of any length are read whole; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentatlas.llm.common import arrow_map, blocks, text_of
from rentatlas.llm.packing import Generations

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Bytes, as they lie in memory, of the words that a worker remembers in each of two generations.
CACHE_BYTES = 32_000_000

# Field numbers and codes of the published model format.
UNIGRAM, PAIRS = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"unknown wire type {kind}")
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What a model file says, as far as encoding needs it."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    mark_behind: bool = False

    @property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)


def read_model(data: bytes) -> Model:
    model = Model()
    for number, value in wire_fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(wire_fields(value))
            model.pieces.append(piece[1].decode())
            model.scores.append(struct.unpack("<f", piece[2])[0])
            model.kinds.append(piece[3])
        elif number == 2:
            spec = dict(wire_fields(value))
            model.kind = spec.get(3, UNIGRAM)
            model.byte_fallback = bool(spec.get(35, 0))
            model.mark_behind = bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(wire_fields(value))
            model.charsmap = spec.get(2, b"")
            model.add_prefix = bool(spec.get(3, 1))
            model.squeeze = bool(spec.get(4, 1))
            model.escape = bool(spec.get(5, 1))
    if model.kind not in (UNIGRAM, PAIRS) or model.mark_behind or not model.escape:
        raise ValueError("only unigram and pair models with a marker in front of words are known")
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first."""
    ids = {p: i for i, p in enumerate(model.pieces)}
    found = []
    for i, (piece, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)):
        if kind in (NORMAL, USER):
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in ids and b in ids:
                    found.append((-model.scores[i], i, ids[a], ids[b], a, b))
    found.sort()
    return [(a, b) for *_, a, b in found]


def rebuild(model: Model):
    """(tokenizer of whole texts, tokenizer of normalised words) of the tokenizers library."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unknown = model.unknown
    if model.kind == UNIGRAM:
        vocab = list(zip(model.pieces, model.scores, strict=True))
        core = models.Unigram(vocab, unknown, model.byte_fallback)
    else:
        vocab = {p: i for i, p in enumerate(model.pieces)}
        core = models.BPE(
            vocab, merges_of(model), unk_token=model.pieces[unknown], fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    whole, words = Tokenizer(core), Tokenizer(core)
    whole.normalizer = normalizers.Sequence(steps)
    user = [p for p, k in zip(model.pieces, model.kinds, strict=True) if k == USER]
    if user:
        whole.add_tokens([AddedToken(p, normalized=False) for p in user])
    behind = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.add_prefix:
        behind.append(decoders.Strip(" ", 1, 0))
    whole.decoder = decoders.Sequence(behind)
    return whole, words


class Codec:
    """Encodes and decodes whole texts; see the module for what it remembers."""

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        with open(path, "rb") as file:
            self.model = read_model(file.read())
        self.tokenizer, self.words_only = rebuild(self.model)
        normal = [p for p, k in zip(self.model.pieces, self.model.kinds, strict=True) if k in (
            NORMAL, USER)]
        self.by_word = (
            not self.model.charsmap and not self.model.squeeze and self.model.add_prefix
            and self.model.byte_fallback and USER not in self.model.kinds
            and not any(MARK in p.lstrip(MARK) for p in normal)
        )
        self.surface = [
            bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode()
            for p, k in zip(self.model.pieces, self.model.kinds, strict=True)
        ]
        self.size = np.array(
            [1 if k == BYTE else len(p.encode())
             for p, k in zip(self.model.pieces, self.model.kinds, strict=True)]
        )
        self.is_byte = np.array([k == BYTE for k in self.model.kinds])
        self.words = Generations(limit)

    def encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words that were not remembered."""
        marked = [MARK + w for w in words]
        made = self.words_only.encode_batch_fast(
            [marked], is_pretokenized=True, add_special_tokens=False
        )[0]
        ids = np.array(made.ids, "<u4")
        data, at = ids.tobytes(), 0
        ends = np.cumsum(np.fromiter((len(m.encode()) for m in marked), np.int64, len(marked)))
        ends = 4 * (np.searchsorted(np.cumsum(self.size[ids]), ends) + 1)
        found = []
        for word, end in zip(words, ends.tolist(), strict=True):
            found.append(data[at:end])
            self.words.put(word, found[-1])
            at = end
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, little-endian 32 bits."""
        if not self.by_word or not len(texts):
            return self.encode_whole(texts.to_pylist())
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # Markers next to each other can join, so texts with runs of spaces are encoded whole.
        odd_word = np.fromiter((not w or w[0] == MARK or w[-1] == MARK for w in different), bool,
                               len(different))
        at = coded.indices.to_numpy()
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        odd = np.add.reduceat(odd_word[at], bounds[:-1]) > 0
        needed = np.zeros(len(different), bool)
        needed[at[~np.repeat(odd, np.diff(bounds))]] = True
        needed = np.flatnonzero(needed).tolist()
        found: list[bytes | None] = [b""] * len(different)
        for i in needed:
            found[i] = self.words.get(different[i])
        new = [i for i in needed if found[i] is None]
        if new:
            for i, made in zip(new, self._learn([different[i] for i in new]), strict=True):
                found[i] = made
        ids = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        lengths = size[at]
        before = np.concatenate([[0], np.cumsum(lengths)])
        here = np.arange(before[-1], dtype=np.int32) + np.repeat(
            (first[at] - before[:-1]).astype(np.int32), lengths
        )
        data = ids[here]
        ends = before[bounds].tolist()
        whole = iter(self.encode_whole(texts.filter(pa.array(odd)).to_pylist()))
        return [
            next(whole) if is_odd else data[a:b]
            for is_odd, a, b in zip(odd.tolist(), ends, ends[1:], strict=False)
        ]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no text become replacement characters."""
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.model.add_prefix and text.startswith(" ") else text


@cache
def codec(path: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(path)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def parity(path: str, texts: list[str]) -> list[int]:
    """Places of the texts that the original library encodes or decodes differently."""
    import sentencepiece

    original = sentencepiece.SentencePieceProcessor(model_file=path)
    own = codec(path)
    mine = own.encode(pa.array(texts, pa.string()))
    theirs = original.encode(texts, num_threads=1)
    return [
        i for i, (a, b) in enumerate(zip(mine, theirs, strict=True))
        if a.tolist() != b or own.decode(a) != original.decode(b)
    ]


RESULT = (
    "doc_id long, n_ids long, ids_crc32 long, n_byte_ids long, n_unknown long, round_trip boolean"
)


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Ids of every whole text in figures, with ``with_ids`` also the ids themselves.

    ``round_trip`` tells whether the decoded ids give the text again; texts that the normaliser
    changes do not. A text that begins with a space loses it, as in the original library.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in blocks(batches):
            texts = batch.column("text")
            ids = own.encode(texts)
            decoded = [own.decode(i) for i in ids]
            columns = [
                batch.column("doc_id"),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                pa.array([int(own.is_byte[i].sum()) for i in ids], pa.int64()),
                pa.array([int((i == own.model.unknown).sum()) for i in ids], pa.int64()),
                pa.array([a == b for a, b in zip(decoded, texts.to_pylist(), strict=True)]),
            ]
            names = RESULT.replace(",", "").split()[::2]
            if with_ids:
                columns.append(pa.array([i.astype("<i4") for i in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return arrow_map(chosen, lambda: run, RESULT + (", ids array<int>" if with_ids else ""))


def decode_ids(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` (``doc_id, ids``) as ``doc_id, text``; missing ids give an empty text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(i or [], np.int64)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    chosen = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return arrow_map(chosen, lambda: run, "doc_id long, text string")
