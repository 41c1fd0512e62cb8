"""Token ids in grammar-compressed shard files.

Documents are put in ascending order of doc_id by a range shuffle, encoded, and closed by an end id.  Consecutive documents
form a shard of about ``SHARD_TOKENS`` ids (a longer document is one shard), and each shard is compressed by Re-Pair: frequent
pairs of neighbouring ids become nonterminals until no pair stands ``LEAST`` times, never across the end of a document.  A
round replaces the most frequent pairs together; where two of them overlap the more frequent one wins.  A shard stores its rules and how many
ids each nonterminal expands to, so that any range of ids is decoded without the rest.

Shards are rows of a Parquet table (part, seq, n_docs, n_tokens, payload) that Spark writes and commits; part and seq give
their order.  A payload is, little-endian: the header ``HEADER`` (magic, documents, rules, symbols, first nonterminal),
the documents' ids (int64) and flags of missing ids (uint8), where each document starts among the symbols (uint32) and among
the ids (uint64), both with a closing entry, the rules (2 x uint32 each), their expansion lengths (uint32), and the symbols
(uint16 where they fit, else uint32).

Defined cases: a null or empty text is the end id alone; rows without doc_id come first; rows that share a doc_id stand in the
order of a hash of their texts, by which they are dealt to tasks too, equal rows by where they were read; an empty table gives no shards and an empty result.  Columns other than the named ones are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aislemetrics.llm.common import SLICE, Memo
from aislemetrics.session import materialise

END_ID = 2
SHARD_TOKENS = 1 << 19
# Rules a round may add, and uses that a pair must have: a rule takes 12 bytes, as much as six symbols of two bytes.
RULES, LEAST = 4_000, 8
HEADER = struct.Struct("<4sIIIQ")
MAGIC = b"RPS1"
_WORD = re.compile(r"[^ \t\n\r]+")
# Texts of these characters are in composed form, with one lower-case character for each of theirs.
_PLAIN = re.compile("[ \t\n\r!-~À-ÖØ-öø-įı-ɏ]*+")
# How the tokenizers meant here split a text (fixed value), and the same for a lower-case word of plain characters.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")

_loaded: dict = {}


class WordIds:
    """Ids of texts by a table of distinct words.

    The tokenizers meant here turn text to lower case, drop white space, and split words into letters, digits and signs
    before they merge, so that a text's ids are its words' ids in a row, and a word's those of its parts.  The library gets
    every new part once, and as a whole every word with characters beyond ``_PLAIN``, for which nothing is assumed about
    lower case or splitting.  Words are forgotten that did not come up again while ``limit`` others did, which changes only
    speed.
    """

    def __init__(self, path: str, limit: int = 800_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # The same model for parts, which need no folding and no splitting any more.
        self.model = Tokenizer.from_file(path)
        steps = json.loads(self.model.to_str())["pre_tokenizer"]["pretokenizers"]
        if [step["type"] for step in steps] != ["Split", "ByteLevel"] or steps[0]["pattern"] != {"Regex": _SPLIT}:
            raise ValueError(f"{path}: a tokenizer that splits words in another way")
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merges = self.model.model
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.special = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.limit = limit
        self.recent: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.marks = {sign: self._ids(sign, self.model) for sign in ",."}
        self.others = Memo(lambda word: self._ids(word, self.library), limit // 8)

    def _ids(self, text: str, library) -> bytes:
        return array(self.code, library.encode(text, add_special_tokens=False).ids).tobytes()

    def _look(self, word: str) -> bytes:
        """Packed ids of a lower-case word of plain characters, which is a recent word afterwards."""
        found = self.recent.get(word) or self.earlier.get(word)
        if not found:
            parts = [word] if word.isalpha() else _PART.findall(word)
            if len(parts) > 1:
                found = b"".join([self._look(part) for part in parts])
            elif word.isascii():  # each character is its own byte, as the model wants it
                found = array(self.code, [token.id for token in self.merges.tokenize(word)]).tobytes()
            else:
                found = self._ids(word, self.model)
        if len(self.recent) >= self.limit:
            self.recent, self.earlier = {}, self.recent
        self.recent[word] = found
        return found

    def _words(self, words: list[str]) -> list[bytes]:
        found, at = list(map(self.recent.get, words)), -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            word = words[at]
            mark = self.marks.get(word[-1])
            if mark and word[-2:-1].isalnum():  # a word before a comma or a full stop is not kept again with that
                found[at] = (self.recent.get(word[:-1]) or self._look(word[:-1])) + mark
            else:
                found[at] = self._look(word)
        return found

    def __call__(self, text: str | None, end: bytes = b"") -> np.ndarray:
        """Ids of a text, and after them the packed id ``end``."""
        text = text or ""
        special = any(token in text for token in self.special)
        if not special and _PLAIN.fullmatch(text):
            found = self._words(text.lower().split())
        else:
            found = [
                self._words([word.lower()])[0] if not special and _PLAIN.fullmatch(word) else self.others[word]
                for word in _WORD.findall(text)
            ]
        found.append(end)
        return np.frombuffer(b"".join(found), self.code)


def word_ids(path: str) -> WordIds:
    """The tables of a tokenizer's file, kept for all tasks of a process."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


class Grammar(NamedTuple):
    first: int  # the first nonterminal
    rules: np.ndarray  # (n, 2)
    lengths: np.ndarray  # ids that each nonterminal expands to
    symbols: np.ndarray
    starts: np.ndarray  # of the documents among the symbols, and the end


def _frequent(keys: np.ndarray, least: int) -> np.ndarray:
    """Keys that stand at least ``least`` times; the more frequent first, then by key."""
    ordered = np.sort(keys)
    if len(ordered) < least:
        return ordered[:0]
    # A value that stands often enough equals the one that many places on; only such are counted.
    early = ordered[: len(ordered) - least + 1]
    often = early[early == ordered[least - 1 :]]
    often = often[np.concatenate(([True], often[1:] != often[:-1]))] if len(often) else often
    counts = np.searchsorted(ordered, often, side="right") - np.searchsorted(ordered, often, side="left")
    return often[np.lexsort((often, -counts))]


def _ranks(keys: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen keys and their ranks, by a table of hashes; chosen keys of one hash take turns in it."""
    bits = 16
    odd = keys.dtype.type(0x9E3779B1 if keys.dtype.itemsize == 4 else 0x9E3779B97F4A7C15)
    cell = lambda x: (x * odd) >> x.dtype.type(8 * x.dtype.itemsize - bits)
    found, at, left, open_ = np.full(len(keys), -1, np.int32), cell(keys), np.arange(len(chosen), dtype=np.int32), None
    while len(left):
        table, rank = np.zeros(1 << bits, keys.dtype), np.full(1 << bits, -1, np.int32)
        own = cell(chosen[left])
        table[own[::-1]], rank[own[::-1]] = chosen[left[::-1]], left[::-1]
        if open_ is None:
            hit = np.flatnonzero(table[at] == keys)
            found[hit] = rank[at[hit]]
        else:
            hit = open_[table[at[open_]] == keys[open_]]
            found[hit] = np.maximum(found[hit], rank[at[hit]])
        lost = rank[own] != left
        left, crowded = left[lost], np.zeros(1 << bits, bool)
        if len(left):
            crowded[own[lost]] = True
            open_ = np.flatnonzero(crowded[at] & (found < 0))
    places = np.flatnonzero(found >= 0)
    return places, found[places]


def _apart(next_: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Which of the pairs to replace: no two overlap, and of two that do the lower rank goes first.

    ``next_`` tells of each pair but the last whether the following one overlaps it.
    """
    places = np.cumsum(np.concatenate(([0], 2 - next_)))
    chained = np.concatenate(([False], next_ & (np.diff(ranks) == 0)))
    begins = np.maximum.accumulate(np.where(chained, 0, np.arange(len(places))))
    open_ = np.flatnonzero((np.arange(len(places)) - begins) % 2 == 0)  # of a run of one pair every second
    taken = []
    for _ in range(2):
        at, rank = places[open_], ranks[open_]
        near = np.diff(at) == 1
        beaten = np.zeros(len(open_), bool)
        beaten[1:] |= near & (rank[1:] > rank[:-1])
        beaten[:-1] |= near & (rank[:-1] > rank[1:])
        winners = ~beaten
        taken.append(open_[winners])
        touched = winners.copy()
        touched[1:] |= near & winners[:-1]
        touched[:-1] |= near & winners[1:]
        open_ = open_[~touched]
        if not len(open_):
            break
    return np.sort(np.concatenate(taken))


def compress(
    ids: np.ndarray, starts: np.ndarray, first: int, rounds: int | None = None, rules: int = RULES, least: int = LEAST
) -> Grammar:
    """Re-Pair over non-empty documents laid end to end; ``starts`` has each document's start and the end of the last.

    Without ``rounds`` it ends when no pair stands ``least`` times.  A pair can become frequent only where a symbol is new, so
    that after the first round only such places are counted, and those of frequent pairs that a round left.
    """
    size = len(ids)
    symbols = np.append(ids, 0).astype(np.uint32)  # one more place, beyond the last and before the first
    closed = np.zeros(size + 1, bool)  # the last symbol of a document
    closed[starts[1:] - 1] = closed[size] = True
    live = np.ones(size + 1, bool)  # a pair's second place dies
    after, before = np.arange(1, size + 2), np.arange(-1, size)
    after[size] = before[0] = size
    places = np.flatnonzero(~closed)
    made, lengths = [np.zeros((0, 2), np.int64)], np.zeros(0, np.int64)
    done = gone = 0
    while rounds is None or done < rounds:
        kind, shift = (np.uint32, 16) if first + len(lengths) < 1 << 16 else (np.uint64, 32)
        keys = symbols[places].astype(kind) << kind(shift)
        keys |= symbols[after[places]]
        chosen = _frequent(keys, least)
        if not len(chosen):
            break
        at, ranks = _ranks(keys, chosen)
        frequent = places[at]
        now = ranks < rules
        spots, ranks = frequent[now], ranks[now]
        picked = _apart(after[spots[:-1]] == spots[1:], ranks)
        spots, ranks = spots[picked], ranks[picked]
        counts = np.bincount(ranks)
        uses = counts >= least  # a pair that lost too many places to others waits
        if not uses.any():
            uses = counts > 0
        kept = uses[ranks]
        spots, ranks = spots[kept], ranks[kept]
        used, ranks = np.flatnonzero(uses), (np.cumsum(uses) - 1)[ranks]
        pairs = np.stack([chosen[used] >> kind(shift), chosen[used] & kind((1 << shift) - 1)], axis=1).astype(np.int64)
        inner = pairs >= first
        sizes = np.ones(pairs.shape, np.int64)
        sizes[inner] = lengths[pairs[inner] - first]
        seconds = after[spots]
        symbols[spots] = first + len(lengths) + ranks
        closed[spots] = closed[seconds]
        live[seconds] = False
        after[spots] = after[seconds]
        before[after[spots]] = spots
        made.append(pairs)
        lengths = np.concatenate([lengths, sizes.sum(axis=1)])
        counted = np.zeros(size + 1, bool)
        counted[frequent] = counted[spots] = counted[before[spots]] = True
        counted &= live & ~closed
        done, gone = done + 1, gone + len(spots)
        if gone > size // 8:
            symbols, closed, counted = symbols[live], closed[live], counted[live]
            size, gone = len(symbols) - 1, 0
            live = np.ones(size + 1, bool)
            after, before = np.arange(1, size + 2), np.arange(-1, size)
            after[size] = before[0] = size
        places = np.flatnonzero(counted)
    symbols, closed = symbols[:-1][live[:-1]], closed[:-1][live[:-1]]
    ends = np.flatnonzero(closed) + 1
    return Grammar(first, np.concatenate(made), lengths, symbols.astype(np.int64), np.concatenate(([0], ends)))


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for."""
    while True:
        inner = symbols >= first
        if not inner.any():
            return symbols
        sizes = 1 + inner
        starts = np.cumsum(sizes) - sizes
        out = np.repeat(symbols, sizes)
        pairs = rules[symbols[inner] - first]
        out[starts[inner]], out[starts[inner] + 1] = pairs[:, 0], pairs[:, 1]
        symbols = out


def pack(doc_ids: list[int | None], id_starts: np.ndarray, grammar: Grammar) -> bytes:
    width = "<u2" if grammar.first + len(grammar.rules) <= 1 << 16 else "<u4"
    return b"".join(
        [
            HEADER.pack(MAGIC, len(doc_ids), len(grammar.rules), len(grammar.symbols), grammar.first),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            grammar.starts.astype("<u4").tobytes(),
            id_starts.astype("<u8").tobytes(),
            grammar.rules.astype("<u4").tobytes(),
            grammar.lengths.astype("<u4").tobytes(),
            grammar.symbols.astype(width).tobytes(),
        ]
    )


class Shard:
    """A payload, opened: any document, and any range of its ids, is decoded by itself."""

    def __init__(self, payload: bytes):
        magic, docs, rules, symbols, self.first = HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a shard of ids")
        at = HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, kind, count, at)
            at += found.nbytes
            return found

        ids, missing = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if gone else int(x) for x, gone in zip(ids, missing)]
        self.starts = take("<u4", docs + 1).astype(np.int64)
        self.id_starts = take("<u8", docs + 1).astype(np.int64)
        self.rules = take("<u4", 2 * rules).astype(np.int64).reshape(-1, 2)
        self.lengths = take("<u4", rules).astype(np.int64)
        self.symbols = take("<u2" if self.first + rules <= 1 << 16 else "<u4", symbols).astype(np.int64)

    def all_ids(self) -> np.ndarray:
        """Ids of all documents, uint32; ``id_starts`` tells them apart.

        Every symbol's expansion is written down once, and the symbols' are picked from there.
        """
        rules = np.arange(self.first, self.first + len(self.rules))
        written = np.concatenate([np.arange(self.first), expand(rules, self.rules, self.first)]).astype("<u4")
        sizes = np.concatenate([np.ones(self.first, np.int64), self.lengths])
        begins = np.cumsum(sizes) - sizes
        each = sizes[self.symbols]
        ends = np.cumsum(each)
        places = np.repeat(begins[self.symbols] - (ends - each), each)
        places += np.arange(len(places))
        return written[places]

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard's document number ``doc``; only symbols that reach into them are expanded."""
        symbols = self.symbols[self.starts[doc] : self.starts[doc + 1]]
        if not start and stop is None:
            return expand(symbols, self.rules, self.first)
        inner = symbols >= self.first
        sizes = np.ones(len(symbols), np.int64)
        sizes[inner] = self.lengths[symbols[inner] - self.first]
        ends = np.cumsum(sizes)
        stop = min(int(ends[-1]) if len(ends) else 0, stop if stop is not None else 1 << 62)
        if start >= stop:
            return symbols[:0]
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        before = int(ends[a] - sizes[a])
        return expand(symbols[a:b], self.rules, self.first)[start - before : stop - before]


SHARDS = "part int, seq long, n_docs long, n_tokens long, payload binary"


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, text_col: str = "text", shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encode every whole text and write the shards to ``path``."""

    def run(batches):
        encode = word_ids(tokenizer)
        first = max(encode.library.get_vocab_size(), end_id + 1)
        part, seq = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []

        def close():
            nonlocal names, held, seq
            starts = np.concatenate(([0], np.cumsum([len(x) for x in held])))
            grammar = compress(np.concatenate(held), starts, first)
            payload = pack(names, starts, grammar)
            values = ([part], [seq], [len(names)], [int(starts[-1])], [payload])
            names, held, seq = [], [], seq + 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [name.split()[0] for name in SHARDS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=columns)

        size, end = 0, array(encode.code, [end_id]).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                for name, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    encoded = encode(text, end)
                    if held and size + len(encoded) > shard_tokens:
                        yield close()
                        size = 0
                    names.append(name)
                    held.append(encoded)
                    size += len(encoded)
        if held:
            yield close()

    rows = docs.select("doc_id", F.col(text_col).alias("text"), F.xxhash64(text_col).alias("sig"), F.spark_partition_id().alias("origin"))
    ordered = rows.repartitionByRange("doc_id", "sig", "origin").sortWithinPartitions("doc_id", "sig", "text")
    ordered.select("doc_id", "text").mapInArrow(run, SHARDS).write.parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, shard_start): ids in all shards before; one running sum a part, and one over the parts' totals."""
    shards = spark.read.parquet(path).select("part", "seq", "n_tokens")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = shards.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("outside"))
    return inside.join(totals, "part").select("part", "seq", (F.col("inside") + F.col("outside")).alias("shard_start"))


def _read(spark: SparkSession, path: str, column: str, take: Callable[[Shard], pa.Array]) -> DataFrame:
    """(part, seq, doc_id, place, and one more column) from the shards; ``take`` makes that from an opened shard."""

    def run(batches):
        for batch in batches:
            for part, seq, payload in zip(*(values.to_pylist() for values in batch.columns)):
                shard = Shard(payload)
                count = len(shard.doc_ids)
                arrays = [
                    pa.array([part] * count, pa.int32()),
                    pa.array([seq] * count, pa.int64()),
                    pa.array(shard.doc_ids, pa.int64()),
                    pa.array(shard.id_starts[:-1], pa.int64()),
                    take(shard),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "seq", "doc_id", "place", column.split()[0]])

    payloads = spark.read.parquet(path).select("part", "seq", "payload")
    return payloads.mapInArrow(run, f"part int, seq long, doc_id long, place long, {column}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, doc_id, place, ids) from the shards: place is the document's start in its shard, ids uint32, little-endian."""

    def packed(shard: Shard) -> pa.Array:
        bounds = pa.array(4 * shard.id_starts, pa.int64()).buffers()[1]
        data = pa.py_buffer(shard.all_ids().tobytes())
        each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(shard.doc_ids), [None, bounds, data])
        return each.cast(pa.binary())

    return _read(spark, path, "ids binary", packed)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its ids as they are read back from the shards."""

    def summed(shard: Shard) -> pa.Array:
        data, bounds = memoryview(shard.all_ids().tobytes()), (4 * shard.id_starts).tolist()
        sums = [zlib.crc32(data[a:b]) for a, b in zip(bounds, bounds[1:])]
        return pa.StructArray.from_arrays(
            [pa.array(np.diff(shard.id_starts), pa.int64()), pa.array(sums, pa.int64())], names=["n_tokens", "ids_crc32"]
        )

    found = _read(spark, path, "digest struct<n_tokens: long, ids_crc32: long>", summed)
    # Written down, the small table has a size by which Spark plans the join.
    placed = found.join(materialise(shard_starts(spark, path), "shard-starts"), ["part", "seq"])
    return placed.select("doc_id", (F.col("shard_start") + F.col("place")).alias("start"), "digest.*")
