"""Packing of token pieces into sequences by exact complements.

Documents become token pieces; only their lengths decide the packing. The lengths are counted (one
row per length, at most ``capacity`` rows whatever the corpus), a plan is made from these counts and
every piece finds its place by its rank among the pieces of its length.

Defined results: a missing text is an empty one and yields the end mark alone; repeated rows are
packed as often as they occur; an empty table yields no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rentatlas.llm.common import arrow_map, blocks, stage, text_of

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Bytes, as they lie in memory, of the words that a worker remembers: those asked for since the memory last
#: filled, and as much again of others.
CACHE_BYTES = 16_000_000
#: Longer words, such as encoded data, are not remembered.
LONGEST_REMEMBERED = 64
#: About what a dictionary entry takes beside the characters and the ids; more than one of a ``WordTable`` takes.
ENTRY_BYTES = 200
#: Texts encoded at a time, in bytes: the arrays of a block are about forty times as long.
ENCODED_BYTES = 1_000_000
#: Salts that one length is spread over while its pieces are numbered.
SALTS = 32

# The published word pattern of byte-level vocabularies,
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
#: A character of each kind that the pattern joins with its like.
SAMPLES = {LETTER: "a", NUMBER: "1", OTHER: "!"}
BLANK, APOSTROPHE = ord(" "), ord("'")
SHORT_ENDINGS = [ord(c) for c in "stmd"]
BETWEEN_WORDS = re.compile(r"(?<=[!-~])[ \n](?=[!-~])")
LONG_ENDINGS = [256 * ord(a) + ord(b) for a, b in ("re", "ve", "ll")]

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, row_key long"
)


class Generations:
    """A dictionary of bounded bytes that forgets what was not asked for since it last filled."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        """Remembers a key that ``get`` did not find, unless it is long."""
        if len(key) > LONGEST_REMEMBERED:
            return
        if self.held > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = value
        self.held += ENTRY_BYTES + len(key) + len(value)


def visible_bytes() -> dict[int, int]:
    """The byte alphabet of byte-level vocabularies: visible Latin-1 stays, the rest follows 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class WordTable:
    """Words with their ids in Arrow and numpy arrays of bounded bytes.

    ``asked`` marks what was looked up since the table last filled; the rest goes when it fills again.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys = pa.array([], pa.binary())
        self.ids = np.zeros(0, np.uint32)
        self.size = np.zeros(0, np.int64)
        self.asked = np.zeros(0, bool)

    def _items(self, chosen: np.ndarray) -> dict[str, bytes]:
        ends = np.cumsum(self.size)
        keys = self.keys.to_pylist()
        return {
            keys[i].decode(): self.ids[ends[i] - self.size[i] : ends[i]].tobytes()
            for i in np.flatnonzero(chosen).tolist()
        }

    @property
    def young(self) -> dict[str, bytes]:
        return self._items(self.asked)

    @property
    def old(self) -> dict[str, bytes]:
        return self._items(~self.asked)

    def keep(self, keys: pa.Array, ids: np.ndarray, size: np.ndarray, asked: np.ndarray) -> None:
        """Remembers the words, those not longer than ``LONGEST_REMEMBERED`` and within the limit."""
        width = pc.binary_length(keys).to_numpy()
        cost = ENTRY_BYTES + width + 4 * size
        chosen = width <= LONGEST_REMEMBERED
        wanted = chosen & asked
        full = cost[wanted].sum() > self.limit
        if full:  # words that have been asked for longest stand in front
            chosen = wanted & (np.cumsum(cost * wanted) <= self.limit)
        if not chosen.all():
            keys = keys.filter(pa.array(chosen))
            ids = ids[np.repeat(chosen, size)]
            size, asked = size[chosen], asked[chosen]
        self.keys, self.ids, self.size = keys, ids, size
        self.asked = np.zeros(len(size), bool) if full else asked


def windows(text: str, size: int = ENCODED_BYTES) -> Iterator[str]:
    """A text in parts of about ``size`` characters, cut before a lone blank or line break."""
    start = 0
    while len(text) - start > size and (found := BETWEEN_WORDS.search(text, start + size)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class CachedEncoder:
    """Token ids of whole texts from the ids of their words.

    A byte-level pattern cuts a text into words that never share a token. The texts of a block are
    cut together, on arrays of their characters; each different word that is not remembered is
    encoded once, by the tokenizer's own model. Which characters are letters, numbers or spaces is
    asked of the tokenizer too. Texts that contain an added token go to the tokenizer whole.
    """

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        pre = config["pre_tokenizer"] or {}
        alphabet = visible_bytes()
        vocab = self.tokenizer.get_vocab()
        self.cuttable = (
            config["normalizer"] is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and all(chr(c) in vocab for c in alphabet.values())
        )
        self.added = [t["content"] for t in config["added_tokens"]]
        # Words of a list are kept apart by a character that is none of the byte alphabet.
        self.words_only = Tokenizer(self.tokenizer.model)
        self.words_only.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.shown = np.array([alphabet[b] for b in range(256)], "<u2")
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.size[i] = len(token)
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.words = WordTable(limit)
        self.parts = self.words  # there is no other memory

    def forget(self) -> None:
        self.words.clear()

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _kinds(self, chars: np.ndarray) -> np.ndarray:
        """Kind of every character; the tokenizer's own pattern joins equal kinds other than spaces."""
        kinds = self.kinds[chars]
        if (kinds == UNKNOWN).any():
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for c in np.unique(chars[kinds == UNKNOWN]).tolist():
                joins = [k for k, like in SAMPLES.items() if len(split(like + chr(c))) == 1]
                self.kinds[c] = joins[0] if joins else SPACE
            kinds = self.kinds[chars]
        return kinds

    def _cut(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether a word of the byte-level pattern begins at each character; texts begin at ``starts``."""
        kinds = self._kinds(chars)
        space = kinds == SPACE
        fresh = np.zeros(len(chars) + 4, bool)  # a few beyond the end, for looking ahead
        fresh[starts] = fresh[len(chars) :] = True
        word = fresh.copy()
        # Where the kind changes; the blank before a word belongs to it, other spaces stand apart.
        word[1 : len(chars)] |= kinds[1:] != kinds[:-1]
        blank = chars == BLANK
        word[1 : len(chars)] &= fresh[1 : len(chars)] | ~(blank[:-1] & ~space[1:])
        # The last space before a visible character is cut from the spaces in front of it.
        last = space & ~fresh[1 : len(chars) + 1]
        last[:-1] &= ~space[1:]
        word[: len(chars)] |= last
        # 's, 't, 'm, 'd, 're, 've and 'll
        mark = np.flatnonzero((chars == APOSTROPHE) & word[: len(chars)])
        if len(mark):
            ahead = np.concatenate([chars, np.zeros(4, chars.dtype)])
            one, two = ahead[mark + 1], ahead[mark + 2]
            short = mark[~fresh[mark + 1] & np.isin(one, SHORT_ENDINGS)]
            long = mark[
                ~fresh[mark + 1] & ~fresh[mark + 2] & np.isin(one * 256 + two, LONG_ENDINGS)
                & (two < 256)
            ]
            word[short + 1] = word[long + 1] = False
            word[short + 2] = word[long + 3] = True
        return word[: len(chars)]

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of words that were not remembered."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        _, offsets, data = words.buffers()
        bounds = np.frombuffer(offsets, np.int32)[words.offset :][: len(words) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        end = bounds[1:] - bounds[0]
        shown = np.full(len(data) + len(end), ord("\n"), "<u2")
        shown[np.arange(len(data)) + np.repeat(np.arange(len(end)), np.diff(bounds))] = self.shown[data]
        made = self.words_only.encode_batch_fast(
            [shown.tobytes().decode("utf-16-le")], add_special_tokens=False
        )[0]
        ids = np.array(made.ids, np.uint32)
        # Tokens of a word add up to its bytes.
        upto = np.searchsorted(np.cumsum(self.size[ids]), end) + 1
        return ids, np.diff(upto, prepend=0)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.cuttable:
            return self._whole(texts.to_pylist())
        odd = np.zeros(len(texts), bool)
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        whole = iter(self._whole(texts.filter(pa.array(odd)).to_pylist()))
        plain = texts.filter(pa.array(~odd)).to_pylist()
        if len(plain) == 1:
            plain = iter([b"".join(self._by_words([w])[0] for w in windows(plain[0]))])
        else:
            plain = iter(self._by_words(plain))
        return [next(whole if is_odd else plain) for is_odd in odd.tolist()]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        joined = "".join(texts)
        if not joined:
            return [b""] * len(texts)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        text_starts = np.concatenate([[0], text_ends[:-1]])
        begins = np.flatnonzero(self._cut(chars, text_starts[text_starts < len(chars)]))
        data = joined.encode()
        at = begins
        if len(data) > len(chars):  # from characters to bytes
            first = np.frombuffer(data, np.uint8)
            at = np.flatnonzero((first & 0xC0) != 0x80)[begins]
        offsets = np.append(at, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(
            pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        )

        # Remembered words stand in front, so a new word is one with a later number.
        table = self.words
        coded = pa.concat_arrays([table.keys, words]).dictionary_encode()
        old = len(table.keys)
        at = coded.indices.to_numpy()[old:]
        asked = np.concatenate([table.asked, np.ones(len(coded.dictionary) - old, bool)])
        asked[at] = True
        ids, size = self._learn(coded.dictionary.slice(old))
        ids, size = np.concatenate([table.ids, ids]), np.concatenate([table.size, size])
        first = np.cumsum(size) - size

        lengths = size[at]
        before = np.concatenate([[0], np.cumsum(lengths)])
        here = np.arange(before[-1], dtype=np.int32) + np.repeat(
            (first[at] - before[:-1]).astype(np.int32), lengths
        )
        made = ids[here].tobytes()
        table.keep(coded.dictionary, ids, size, asked)
        ends = (4 * before[np.searchsorted(begins, text_ends)]).tolist()
        return [made[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@cache
def encoder(path: str) -> CachedEncoder:
    """One encoder for each Python worker."""
    return CachedEncoder(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full pieces, a shorter one only in front."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document, with the CRC-32 of their ids.

    ``row_key`` numbers the pieces for salting only. ``with_ids`` adds the ids themselves.
    """
    end = np.array([end_id], "<u4").tobytes()
    columns = PIECES.split(", ")
    schema = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids_crc32", pa.int64()), ("row_key", pa.int64()),
    ])
    if with_ids:
        schema = schema.append(pa.field("ids", pa.list_(pa.int32())))
        columns = [*columns, "ids array<int>"]

    def make():
        encode = encoder(path)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches, limit=ENCODED_BYTES):
                doc_ids = batch.column("doc_id").to_pylist()
                out: list[list] = [[] for _ in schema]
                for doc_id, ids in zip(doc_ids, encode(batch.column("text")), strict=True):
                    ids += end
                    for k, (s, n) in enumerate(cut_lengths(len(ids) // 4, capacity)):
                        data = ids[4 * s : 4 * (s + n)]
                        crc = zlib.crc32(data)
                        row = [doc_id, k, s, n, crc, crc ^ (s << 7)]
                        if with_ids:
                            row.append(np.frombuffer(data, "<i4"))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema
                )

        return run

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return arrow_map(chosen, make, ", ".join(columns))


class Shelf:
    """Counts of the lengths still to be placed and exact ways to fill a gap from them."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()

    def take(self, lengths: list[int], times: int) -> None:
        for n in lengths:
            self.left[n] -= times

    def times(self, lengths: list[int]) -> int:
        need = np.bincount(lengths, minlength=len(self.left))
        used = np.flatnonzero(need)
        return int((self.left[used] // need[used]).min())

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.left[gap] > 0 else None

    def pair(self, gap: int) -> list[int] | None:
        """Two lengths that sum to the gap, the longest first."""
        high = np.arange(gap - 1, (gap - 1) // 2, -1)
        low = gap - high
        ok = (self.left[high] > 0) & (self.left[low] > (high == low))
        at = np.argmax(ok) if ok.any() else -1
        return None if at < 0 else [int(high[at]), int(low[at])]

    def triple(self, gap: int) -> list[int] | None:
        """Three lengths that sum to the gap; each step looks up the complements of one length."""
        for first in np.flatnonzero(self.left[: max(gap - 1, 0)])[::-1].tolist():
            if 3 * first < gap:
                return None
            self.left[first] -= 1
            rest = self.pair(gap - first)
            self.left[first] += 1
            if rest and self.times([first, *rest]):
                return [first, *rest]
        return None

    def best(self, gap: int) -> int:
        """The longest length that fits, 0 if none does."""
        fits = np.flatnonzero(self.left[: gap + 1])
        return int(fits[-1]) if len(fits) else 0


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in order, how often) so that every counted length is used exactly.

    From the longest length down: single, pair and triple sums that fill its gap exactly come
    first, as often as the counts allow; what has no exact filling gets the best fit. Each step
    uses one length up, so the plan grows with ``capacity`` and not with the corpus.
    """
    held = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        held[n] = k
    shelf = Shelf(held)
    plan = []
    for longest in range(capacity, 0, -1):
        while shelf.left[longest] > 0:
            chosen, gap = [longest], capacity - longest
            shelf.left[longest] -= 1
            while gap:
                exact = shelf.single(gap) or shelf.pair(gap) or shelf.triple(gap)
                step = exact or [n for n in [shelf.best(gap)] if n]
                if not step:
                    break
                shelf.take(step, 1)
                chosen += step
                gap -= sum(step)
            for n in chosen:
                shelf.left[n] += 1
            times = shelf.times(chosen)
            shelf.take(chosen, times)
            plan.append((chosen, times))
    return plan


SLOTS = "length long, first_rank long, end_rank long, first_sequence long, offset long"


def slot_rows(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rank ranges of each length with the sequence and the place they get."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for chosen, times in plan:
        offset = 0
        for n in chosen:
            rank = used.get(n, 0)
            rows.append((n, rank, rank + times, sequence, offset))
            used[n] = rank + times
            offset += n
        sequence += times
    return rows


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any table with ``length`` and ``row_key``) with ``sequence_id, offset``.

    A piece is numbered within its length: first within a salt, then by the counts of the salts
    before, so a length that a third of all pieces share is no single task. The plan, a few rows
    per length, is joined as a broadcast of bounded size.
    """
    spark: SparkSession = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(SALTS)))
    per_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    held = per_salt.collect()  # at most capacity * SALTS rows
    counts: dict[int, int] = {}
    before = []
    for row in sorted(held, key=lambda r: (r.length, r.salt)):
        before.append((row.length, row.salt, counts.get(row.length, 0)))
        counts[row.length] = counts.get(row.length, 0) + row.n
    slots = spark.createDataFrame(slot_rows(plan_sequences(counts, capacity)), SLOTS)
    offsets = spark.createDataFrame(before, "length long, salt long, before long")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "row_key")
    ranked = (
        salted.withColumn("in_salt", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["length", "salt"])
        .withColumn("rank", F.col("in_salt") + F.col("before"))
    )
    by_length = slots.groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("first_rank", "first_sequence", "offset"))).alias(
            "ranges"
        )
    )
    # Ranges of a length follow each other, so the last one that starts at or before the rank
    # holds it.
    hit = F.element_at(
        F.filter("ranges", lambda r: r["first_rank"] <= F.col("rank")), -1
    )
    return (
        ranked.join(F.broadcast(by_length), "length")
        .withColumn("hit", hit)
        .withColumn("sequence_id", F.col("hit.first_sequence") + F.col("rank") - F.col(
            "hit.first_rank"
        ))
        .withColumn("offset", F.col("hit.offset"))
        .drop("salt", "in_salt", "before", "rank", "ranges", "hit", "row_key")
    )


def pack_documents(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Every token piece of ``docs`` with its sequence and place.

    Tokens are made once; the pieces are written to the shared folder and read for the plan and
    for the placing.
    """
    pieces = stage(
        token_pieces(docs, path or tokenizer_path(), capacity, end_id, with_ids), "pieces"
    )
    return place(pieces, capacity)
