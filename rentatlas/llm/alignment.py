"""Alignment of two tokenizers over all documents, with corpus-wide counts of linked token pairs.

First pass: a text is encoded by both tokenizers, the byte ends of both token rows are merged, and
every stretch between neighbouring ends is one link of an A token and a B token. A task writes blocks
of documents: their ids, their tokens (compressed) and the pairs of the block with their counts.

Counts: the distinct pairs are dealt into shards by hash; each shard builds a minimal perfect hash of
its pairs (bit arrays, level by level, with ranks), so a pair's slot is a number below the number of
pairs. Counts are dense vectors over the slots: blocks are added into one vector per shard and leaf,
and the vectors are summed up a tree of ``FAN_IN`` children a node. The pair stored at a slot verifies
a look-up.

Second pass: each block's pairs are looked up in the shards, the answers return to their block, its
documents are aligned again from the stored tokens and read their counts.

Bounds: a block holds ``BLOCK_BYTES`` of text or one longer text; there is a shard for every
``SHARD_PAIRS`` pairs that the blocks hold, so nothing that grows with the corpus is broadcast or
collected; the best count of every B id (as many rows as the B vocabulary) is.

Defined results: a missing or empty text, and one that a tokenizer doesn't give back byte by byte, has
no tokens, zeros and an empty digest; repeated rows count and answer each; an empty table yields no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentatlas.llm.common import arrow_map, blocks, stage, text_of
from rentatlas.llm.packing import tokenizer_path, visible_bytes
from rentatlas.llm.pieces import model_path

#: Text of a block, and pairs (of all blocks) a shard stands for.
BLOCK_BYTES = 2_000_000
SHARD_PAIRS = 1 << 20
LEAVES = 16
FAN_IN = 4
#: Bits of a level of the perfect hash for each key still to be placed.
SPREAD = 2

U = np.uint64


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Every bit of ``x`` spread over 64 bits, differently for each seed."""
    x = x.astype(U) + U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class PerfectHash:
    """A minimal perfect hash: distinct keys to 0 .. n-1.

    Level by level, keys fall on a bit array; a key alone on its bit is placed there, the others go
    to the next level. A key's slot is the number of bits set before its own.
    """

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes
        self.before, total = [], 0
        for words in levels:
            count = np.bitwise_count(words).astype(np.int64)
            self.before.append(total + np.cumsum(count) - count)
            total += int(count.sum())
        self.n = total

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, sizes = [], []
        while len(keys):
            size = max(64, SPREAD * len(keys))
            place = (mixed(keys, len(levels)) % U(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size)[place] == 1
            words = np.zeros(-(-size // 64), U)
            np.bitwise_or.at(words, place[alone] >> 6, U(1) << (place[alone] & 63).astype(U))
            levels.append(words)
            sizes.append(size)
            keys = keys[~alone]
        return cls(levels, sizes)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slots; keys never given may get any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (words, size) in enumerate(zip(self.levels, self.sizes, strict=True)):
            place = (mixed(keys[left], level) % U(size)).astype(np.int64)
            word, bit = words[place >> 6], (place & 63).astype(U)
            hit = (word >> bit) & U(1) == U(1)
            below = np.bitwise_count(word & ((U(1) << bit) - U(1))).astype(np.int64)
            out[left[hit]] = (self.before[level][place >> 6] + below)[hit]
            left = left[~hit]
            if not len(left):
                break
        return out

    def dumps(self) -> bytes:
        head = struct.pack(f"<{len(self.sizes) + 1}q", len(self.sizes), *self.sizes)
        return head + b"".join(w.tobytes() for w in self.levels)

    @classmethod
    def loads(cls, data: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<q", data)
        sizes = list(struct.unpack_from(f"<{n}q", data, 8))
        levels, at = [], 8 * (n + 1)
        for size in sizes:
            words = -(-size // 64)
            levels.append(np.frombuffer(data, U, words, at))
            at += 8 * words
        return cls(levels, sizes)


# -- tokens and links


class Pair:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.path_a = path_a
        with open(path_a, encoding="utf-8") as file:
            config = json.load(file)
        back = {chr(c): b for b, c in visible_bytes().items()}
        special = {t["content"] for t in config["added_tokens"]}
        vocab = config["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if token not in special:
                self.bytes_a[i] = bytes(back[c] for c in token)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            if self.pieces.is_byte(i):
                self.bytes_b.append(bytes([int(piece[3:5], 16)]))
            elif self.pieces.is_control(i) or self.pieces.is_unknown(i):
                self.bytes_b.append(b"")
            else:
                self.bytes_b.append(piece.replace("▁", " ").encode())
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])

    @cached_property
    def whole(self):
        """The tokenizer as its file describes it."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path_a)
        made.encode_special_tokens = True
        return made

    @cached_property
    def fast(self):
        """The same ids, four times as fast and without a memory of words.

        Merges of the file are made in the order of the ids they make, so ids serve as ranks.
        """
        import tiktoken
        from public_tokenizers import PATTERN

        ranks = {token: i for i, token in enumerate(self.bytes_a) if token}
        return tiktoken.Encoding("pair", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def shown(self) -> list[str]:
        """Decimal ids with what follows: the next token of the group, or what ends its half."""
        na, nb = len(self.bytes_a), len(self.bytes_b)
        return (
            [f"{i}," for i in range(na)] + [f"{i}|" for i in range(na)]
            + [f"{i}," for i in range(nb)] + [f"{i};" for i in range(nb)]
        )

    def ids_a(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except Exception:  # the pattern engine gives up on some endless runs
            return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tokens of each text; none where either side doesn't give ``" " + text`` back."""
        out = []
        for text in texts:
            b = self.pieces.encode(text)
            a = self.ids_a(" " + text) if text else []
            raw = b" " + text.encode()
            same = (
                bool(text)
                and b"".join(map(self.bytes_a.__getitem__, a)) == raw
                and b"".join(map(self.bytes_b.__getitem__, b)) == raw
            )
            out.append(tuple(np.array(x if same else [], "<u4") for x in (a, b)))
        return out


@cache
def tokenizers(path_a: str, path_b: str) -> Pair:
    """One pair for each Python worker."""
    return Pair(path_a, path_b)


@dataclass
class Aligned:
    """Links of a block: pair numbers, how many each document has, and the groups' token order."""

    links: np.ndarray
    n_links: np.ndarray
    n_groups: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def per_doc(ends: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """How many ascending ``ends`` each document has, whose bytes end at ``stops``."""
    return np.diff(np.searchsorted(ends, stops, "right"), prepend=0)


def align(pair: Pair, a: np.ndarray, b: np.ndarray, n_a: np.ndarray) -> Aligned:
    """Alignment of the documents of a block, whose bytes are laid one behind the other."""
    ends_a, ends_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
    stops = np.concatenate([[0], ends_a])[np.cumsum(n_a)]
    ends = np.concatenate([ends_a, ends_b])
    ends.sort(kind="stable")
    new = np.ones(len(ends), bool)
    new[1:] = ends[1:] != ends[:-1]
    shared = ends[1:][~new[1:]]
    ends = ends[new]
    links = (a[np.searchsorted(ends_a, ends)].astype(np.int64) << 32) | b[
        np.searchsorted(ends_b, ends)
    ].astype(np.int64)
    return Aligned(
        links, per_doc(ends, stops), per_doc(shared, stops),
        np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b),
    )


def group_texts(
    pair: Pair, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, found: Aligned
) -> Iterator[str]:
    """The groups of each document: A ids, ``|``, B ids, ``;`` and the next."""
    ga, gb = found.group_a, found.group_b
    last_a, last_b = np.ones(len(a), bool), np.ones(len(b), bool)
    last_a[:-1], last_b[:-1] = ga[1:] != ga[:-1], gb[1:] != gb[:-1]
    code = np.empty(len(a) + len(b), np.int64)
    # An A token stands behind the B tokens of earlier groups, a B token behind the A's of its own too.
    code[np.arange(len(a)) + np.searchsorted(gb, ga)] = a + len(pair.bytes_a) * last_a
    code[np.arange(len(b)) + np.searchsorted(ga, gb, "right")] = (
        b + 2 * len(pair.bytes_a) + len(pair.bytes_b) * last_b
    )
    at = 0
    for n in (n_a + n_b).tolist():
        yield "".join(map(pair.shown.__getitem__, code[at : at + n].tolist()))[:-1]
        at += n


# -- first pass

BLOCK = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, a binary, b binary, "
    "pairs binary, counts binary, n_pairs long"
)


def _one(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([columns[f.name]], f.type) for f in schema], schema=schema
    )


BLOCK_SCHEMA = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())),
    ("n_b", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary()),
    ("pairs", pa.binary()), ("counts", pa.binary()), ("n_pairs", pa.int64()),
])


def token_blocks(docs: DataFrame, path_a: str, path_b: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents with their tokens and the counts of their pairs."""

    def make():
        import zstandard

        pair = tokenizers(path_a, path_b)
        pack = zstandard.ZstdCompressor(level=1).compress

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches, limit=limit):
                ids = pair.encode(batch.column("text").to_pylist())
                a, b = (np.concatenate([x[k] for x in ids]) for k in (0, 1))
                n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
                pairs, counts = np.unique(align(pair, a, b, n_a).links, return_counts=True)
                yield _one(
                    {
                        "block": uuid.uuid4().int >> 65, "doc_ids": batch.column("doc_id").to_pylist(),
                        "n_a": n_a.tolist(), "n_b": n_b.tolist(), "a": pack(a.tobytes()),
                        "b": pack(b.tobytes()), "pairs": pairs.tobytes(),
                        "counts": counts.astype(np.int64).tobytes(), "n_pairs": len(pairs),
                    },
                    BLOCK_SCHEMA,
                )

        return run

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return arrow_map(chosen, make, BLOCK)


# -- counts


def sharded(blocked: DataFrame, shards: int) -> DataFrame:
    """``shard, leaf, block, pairs, counts``: the pairs of each block, dealt by their hash."""
    schema = pa.schema([
        ("shard", pa.int64()), ("leaf", pa.int32()), ("block", pa.int64()),
        ("pairs", pa.binary()), ("counts", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = np.frombuffer(row["pairs"], np.int64)
                counts = np.frombuffer(row["counts"], np.int64)
                shard = (mixed(pairs, 99) % U(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                used, first = np.unique(shard[order], return_index=True)
                parts = np.split(order, first[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used), pa.array([row["block"] % LEAVES] * len(used), pa.int32()),
                        pa.array([row["block"]] * len(used), pa.int64()),
                        pa.array([pairs[p].tobytes() for p in parts[: len(used)]], pa.binary()),
                        pa.array([counts[p].tobytes() for p in parts[: len(used)]], pa.binary()),
                    ],
                    schema=schema,
                )

    return arrow_map(
        blocked.select("block", "pairs", "counts"), lambda: run,
        "shard long, leaf int, block long, pairs binary, counts binary",
    )


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64)


def perfect_hashes(dealt: DataFrame) -> DataFrame:
    """``shard, hash, keys``: a perfect hash of each shard's distinct pairs, and the pairs by slot."""
    schema = pa.schema([("shard", pa.int64()), ("hash", pa.binary()), ("keys", pa.binary())])

    def distinct(table: pa.Table) -> pa.Table:
        row = {"shard": table["shard"][0].as_py(), "leaf": table["leaf"][0].as_py()}
        row["pairs"] = np.unique(_numbers(table["pairs"])).tobytes()
        return pa.Table.from_batches([_one(row, pa.schema([
            ("shard", pa.int64()), ("leaf", pa.int32()), ("pairs", pa.binary()),
        ]))])

    def build(table: pa.Table) -> pa.Table:
        pairs = np.unique(_numbers(table["pairs"]))
        made = PerfectHash.of(pairs)
        keys = np.empty(len(pairs), np.int64)
        keys[made(pairs)] = pairs
        return pa.Table.from_batches([_one(
            {"shard": table["shard"][0].as_py(), "hash": made.dumps(), "keys": keys.tobytes()},
            schema,
        )])

    leaves = dealt.select("shard", "leaf", "pairs").groupBy("shard", "leaf").applyInArrow(
        distinct, "shard long, leaf int, pairs binary"
    )
    return leaves.groupBy("shard").applyInArrow(build, "shard long, hash binary, keys binary")


def count_vectors(dealt: DataFrame, hashes: DataFrame) -> DataFrame:
    """``shard, vector``: the corpus-wide count at every slot, summed up a tree of leaves."""
    schema = pa.schema([("shard", pa.int64()), ("node", pa.int32()), ("vector", pa.binary())])
    names = "shard long, node int, vector binary"

    def leaf_vector(rows: pa.Table, index: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        slots = PerfectHash.loads(index["hash"][0].as_py())
        vector = np.zeros(slots.n, np.int64)
        for pairs, counts in zip(rows["pairs"].to_pylist(), rows["counts"].to_pylist(), strict=True):
            # The pairs of a block are distinct, and so are their slots.
            vector[slots(np.frombuffer(pairs, np.int64))] += np.frombuffer(counts, np.int64)
        return pa.Table.from_batches([_one(
            {"shard": rows["shard"][0].as_py(), "node": rows["leaf"][0].as_py(),
             "vector": vector.tobytes()}, schema,
        )])

    def added(table: pa.Table) -> pa.Table:
        vector = np.sum([np.frombuffer(v, np.int64) for v in table["vector"].to_pylist()], axis=0)
        return pa.Table.from_batches([_one(
            {"shard": table["shard"][0].as_py(), "node": table["node"][0].as_py() // FAN_IN,
             "vector": vector.astype(np.int64).tobytes()}, schema,
        )])

    spread = hashes.select("shard", "hash").withColumn(
        "leaf", F.explode(F.sequence(F.lit(0), F.lit(LEAVES - 1)))
    )
    nodes = dealt.groupBy("shard", "leaf").cogroup(spread.groupBy("shard", "leaf")).applyInArrow(
        leaf_vector, names
    )
    width = LEAVES
    while width > 1:
        nodes = nodes.groupBy("shard", F.expr(f"node div {FAN_IN}").alias("parent")).applyInArrow(
            added, names
        )
        width = -(-width // FAN_IN)
    return nodes.select("shard", "vector")


def best_counts(index: DataFrame) -> DataFrame:
    """``b, best``: the highest count of every B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(0, np.int64)
        for batch in batches:
            for keys, vector in zip(batch.column("keys").to_pylist(),
                                    batch.column("vector").to_pylist(), strict=True):
                b = np.frombuffer(keys, np.int64) & 0xFFFFFFFF
                if len(b) and b.max() >= len(best):
                    best = np.append(best, np.zeros(b.max() + 1 - len(best), np.int64))
                np.maximum.at(best, b, np.frombuffer(vector, np.int64))
        used = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(best[used])], ["b", "best"])

    rows = arrow_map(index.select("keys", "vector"), lambda: run, "b long, best long")
    return rows.groupBy("b").agg(F.max("best").alias("best"))


# -- second pass

RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)


def looked_up(dealt: DataFrame, index: DataFrame) -> DataFrame:
    """``block, pairs, found``: the corpus-wide counts of each block's pairs, shard by shard."""
    schema = pa.schema([("block", pa.int64()), ("pairs", pa.binary()), ("found", pa.binary())])

    def answers(rows: pa.Table, index: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        slots = PerfectHash.loads(index["hash"][0].as_py())
        keys = np.frombuffer(index["keys"][0].as_py(), np.int64)
        vector = np.frombuffer(index["vector"][0].as_py(), np.int64)
        found = []
        for data in rows["pairs"].to_pylist():
            pairs = np.frombuffer(data, np.int64)
            at = slots(pairs)
            if (at < 0).any() or (keys[at] != pairs).any():
                raise ValueError("a pair was looked up that no document holds")
            found.append(vector[at].tobytes())
        return pa.table(
            [rows["block"], rows["pairs"], pa.array(found, pa.binary())], schema=schema
        )

    spread = index.withColumn("leaf", F.explode(F.sequence(F.lit(0), F.lit(LEAVES - 1))))
    return dealt.groupBy("shard", "leaf").cogroup(spread.groupBy("shard", "leaf")).applyInArrow(
        answers, "block long, pairs binary, found binary"
    )


def align_documents(
    docs: DataFrame, path_a: str | None = None, path_b: str | None = None,
    limit: int = BLOCK_BYTES, shard_pairs: int = SHARD_PAIRS,
) -> DataFrame:
    """Figures of the alignment of every document; see the module."""
    path_a, path_b = path_a or tokenizer_path(), path_b or model_path()
    blocked = stage(token_blocks(docs, path_a, path_b, limit), "token-blocks")
    total = blocked.agg(F.sum("n_pairs")).first()[0] or 0
    dealt = stage(sharded(blocked, max(1, -(-total // shard_pairs))), "pairs")
    hashes = stage(perfect_hashes(dealt), "hashes")
    index = stage(hashes.join(count_vectors(dealt, hashes), "shard"), "counts")
    best = best_counts(index).toArrow()
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((best["b"].to_numpy(), best["best"].to_numpy()))
    schema = pa.schema([(n, pa.int64()) for n in RESULT.replace(",", "").split()[:14:2]]
                       + [("groups_sha256", pa.string())])

    def second(rows: pa.Table, answers: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        pair = tokenizers(path_a, path_b)
        pairs, found = _numbers(answers["pairs"]), _numbers(answers["found"])
        order = np.argsort(pairs)
        pairs, found = pairs[order], found[order]
        best = np.zeros(len(pair.bytes_b), np.int64)
        best[sent.value[0]] = sent.value[1]
        # Rows of a block written by a repeated task have other block numbers, so there is one row.
        (row,) = rows.to_pylist()
        a, b = (np.frombuffer(unpack(row[k]), "<u4") for k in ("a", "b"))
        n_a, n_b = np.array(row["n_a"], np.int64), np.array(row["n_b"], np.int64)
        aligned = align(pair, a, b, n_a)
        count = found[np.searchsorted(pairs, aligned.links)]
        is_best = count == best[aligned.links & 0xFFFFFFFF]
        stops = np.cumsum(aligned.n_links)
        sums, bests = (
            np.diff(np.concatenate([[0], np.cumsum(x)])[stops], prepend=0) for x in (count, is_best)
        )
        shas = [
            hashlib.sha256(t.encode()).hexdigest() if t else ""
            for t in group_texts(pair, a, b, n_a, n_b, aligned)
        ]
        figures = (n_a, n_b, aligned.n_groups, aligned.n_links, bests, sums)
        return pa.table(
            [pa.array(row["doc_ids"], pa.int64()), *(pa.array(x, pa.int64()) for x in figures),
             pa.array(shas, pa.string())],
            schema=schema,
        )

    tokens = blocked.select("block", "doc_ids", "n_a", "n_b", "a", "b")
    return tokens.groupBy("block").cogroup(looked_up(dealt, index).groupBy("block")).applyInArrow(
        second, RESULT
    )
