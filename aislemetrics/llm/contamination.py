"""Benchmark decontamination by one Aho-Corasick automaton over normalised test items.

Texts and items are lower-cased (A-Z) and cut into words of letters, digits and all characters beyond ASCII, and words are
numbered.  Every window of ten consecutive words of an item, or the whole of a shorter item, is one pattern of numbers.  The
automaton is kept as sorted arrays, one a depth: a state's number times the number of words plus the next word gives the
state below.  The states at one depth are the distinct beginnings of that many words, so windows of one text share them and
a state takes eight bytes.  A state's failure link is the state of its words but the first.  A slice of texts is read once,
all its positions together, one depth after the other: where a walk has no way down, its failure link is where the walk of
the next position stands already.  Every final state gives the words it covers and, by the words' offsets, the characters of
the original text.

The items are the stated set that goes to every task, in blocks of at most ``BLOCK_CHARS`` characters (or one item), which
bounds an automaton to some 150 MB; one block is the usual case, and its automaton is built once a process.  With more
blocks a task holds ``CHUNK_CHARS`` characters of texts at a time, and passes them through one automaton after the other.

Defined cases: a null or empty text has no words and no hits; texts of any length are read whole; items that are null or
without words are left out; an item without an id marks words but is not counted or named; repeated item ids count once;
repeated documents come back as often as they stand; empty tables give an empty result or no hits.  Columns other than the
named ones are not read.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from aislemetrics.llm.common import SLICE, bounded_batches

WINDOW = 10
BLOCK_CHARS = 8_000_000
# Texts that a task passes through one automaton before it builds the next.
CHUNK_CHARS = 64_000_000

# Bytes: A-Z to a-z; letters, digits and bytes beyond ASCII stay; all others separate words.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_built: dict[str, object] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """Aho-Corasick automaton of all windows of ``items`` (id, text), in sorted arrays."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.ids = [item for item, _ in items]
        every = [[self.numbers.setdefault(word, len(self.numbers)) for word in words_of(text)] for _, text in items]
        words = np.fromiter((number for own in every for number in own), np.int64)
        sizes = np.array([len(own) for own in every], np.int64)
        item = np.repeat(np.arange(len(every)), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        length = np.minimum(window, sizes)[item]  # of the windows of the position's item
        starts = np.flatnonzero(np.arange(len(words)) + length <= first + sizes[item])
        length, item = length[starts], item[starts]
        state = np.zeros(len(starts), np.int64)
        # By depth: the keys of its states, and the items of its final states as sorted pairs (state, item).
        self.keys: list[np.ndarray] = []
        self.finals: list[tuple[np.ndarray, np.ndarray]] = []
        for depth in range(1, window + 1):
            on = length >= depth
            starts, length, item, state = starts[on], length[on], item[on], state[on]
            if not len(starts):
                break
            keys, state = np.unique(state * len(self.numbers) + words[starts + depth - 1], return_inverse=True)
            ends = length == depth
            pairs = np.unique(np.stack([state[ends], item[ends]]), axis=1)
            self.keys.append(keys)
            self.finals.append((pairs[0], pairs[1]))

    def scan(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray | None, set]]:
        """Of every text, given as its words: where runs of hits begin and end, or None; the ids of the items found."""
        get = self.numbers.get
        words = np.array([get(word, -1) for text in texts for word in text], np.int64)
        ends = np.cumsum([len(text) for text in texts])
        edges: list[np.ndarray | None] = [None] * len(texts)
        named: list[set] = [set() for _ in texts]
        at = np.flatnonzero(words >= 0)
        state = np.zeros(len(at), np.int64)
        last = ends[np.searchsorted(ends, at, "right")] if len(at) else at
        for depth, (keys, (finals, owners)) in enumerate(zip(self.keys, self.finals, strict=True), 1):
            on = at + depth <= last
            at, state, last = at[on], state[on], last[on]
            wanted = state * len(self.numbers) + words[at + depth - 1]
            wanted[words[at + depth - 1] < 0] = -1
            state = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            on = keys[state] == wanted
            at, state, last = at[on], state[on], last[on]
            if not len(at):
                break
            begin = np.searchsorted(finals, state)
            for place in np.flatnonzero(np.searchsorted(finals, state, "right") > begin):
                text = int(np.searchsorted(ends, at[place], "right"))
                if edges[text] is None:
                    edges[text] = np.zeros(len(texts[text]) + 1, np.int64)
                here = int(at[place] - ends[text] + len(texts[text]))
                edges[text][here] += 1
                edges[text][here + depth] -= 1
                stop = int(np.searchsorted(finals, state[place], "right"))
                named[text].update(self.ids[owner] for owner in owners[begin[place] : stop])
        for ids in named:
            ids.discard(None)
        return list(zip(edges, named, strict=True))


def _automaton(block: Broadcast, key: str | None, window: int) -> Automaton:
    """The automaton of a block; kept under ``key``, if given, for the process's later tasks."""
    if key is None:
        return Automaton(block.value, window)
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(block.value, window)
    return _built[key]


def blocks(items: DataFrame, limit: int = BLOCK_CHARS) -> list[Broadcast]:
    """Items (item_id, text) as broadcast blocks of at most ``limit`` characters, read one block at a time."""
    context, found, part, size = items.sparkSession.sparkContext, [], [], 0
    for row in items.select("item_id", "text").where("text is not null").toLocalIterator():
        if part and size + len(row.text) > limit:
            found.append(context.broadcast(part))
            part, size = [], 0
        part.append((row.item_id, row.text))
        size += len(row.text)
    return [*found, context.broadcast(part)] if part else found


def contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, limit: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, n_words, n_hit, items array<string>, spans array<struct<start, end>>) of every row.

    n_hit counts words inside an occurrence of a window; items are the distinct ids of items with one, sorted as strings;
    spans are the runs of hit words as code points of the original text, end exclusive.
    """
    bounded_batches(docs.sparkSession)
    parts = blocks(items, limit)
    scan, chars = _scanner(parts, window), CHUNK_CHARS if len(parts) > 1 else 0
    new = "n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>"
    result = StructType([docs.schema["doc_id"], *docs.sparkSession.createDataFrame([], new).schema])

    def run(batches):
        target = to_arrow_schema(result)
        for batch, texts, found in _scanned(batches, 1, scan, chars):
            rows = [_row(text, *hits) for text, hits in zip(texts, found, strict=True)]
            made = [pa.array([row[k] for row in rows], target[k + 1].type) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], schema=target)

    return docs.select("doc_id", text_col).mapInArrow(run, result)


def clean_documents(
    docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, limit: int = BLOCK_CHARS
) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text holds no window of an item."""
    bounded_batches(docs.sparkSession)
    parts = blocks(items, limit)
    scan, chars = _scanner(parts, window), CHUNK_CHARS if len(parts) > 1 else 0
    place = docs.columns.index(text_col)

    def run(batches):
        for batch, _, found in _scanned(batches, place, scan, chars):
            yield batch.filter(pa.array([edges is None for _, edges, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _scanned(batches, place: int, scan, chars: int):
    """(batch, its texts, what ``scan`` finds in them), for batches of at least ``chars`` characters together."""

    def found():
        hits = scan([text for _, texts in held for text in texts])
        at = 0
        for batch, texts in held:
            yield batch, texts, hits[at : at + len(texts)]
            at += len(texts)
        held.clear()

    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            held.append((part, part.column(place).to_pylist()))
            size += sum(len(text or "") for text in held[-1][1])
            if size >= chars:
                yield from found()
                size = 0
    if held:
        yield from found()


def _scanner(parts: list[Broadcast], window: int):
    """A function from texts to (number of words, edges of the hit runs or None, ids of the items found) of each."""
    key = uuid.uuid4().hex if len(parts) == 1 else None

    def scan(texts: list[str | None]) -> list[tuple[int, np.ndarray | None, set]]:
        counts = [0] * len(texts)
        edges: list[np.ndarray | None] = [None] * len(texts)
        named: list[set] = [set() for _ in texts]
        for part in parts or [None]:
            known = _automaton(part, key, window) if part else Automaton([], window)
            for at in range(0, len(texts), SLICE):
                split = [words_of(text) for text in texts[at : at + SLICE]]
                for i, (more, ids) in enumerate(known.scan(split), at):
                    counts[i] = len(split[i - at])
                    edges[i] = more if edges[i] is None else edges[i] if more is None else edges[i] + more
                    named[i] |= ids
        return list(zip(counts, edges, named, strict=True))

    return scan


def _row(text: str | None, n_words: int, edges: np.ndarray | None, ids) -> tuple:
    if edges is None:
        return n_words, 0, [], []
    hit = np.cumsum(edges[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    places = [match.span() for match in _WORD.finditer(text)]
    spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(turns[::2], turns[1::2])]
    return n_words, int(hit.sum()), sorted({str(item) for item in ids}), spans


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of what ``contamination`` returns."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
