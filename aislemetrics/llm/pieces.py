"""Piece encoding by a table of distinct chunks, and decoding.

In the vocabularies meant here a piece may hold white-space markers only at its start, so no merge crosses the border
between a text character and a following marker.  A text is therefore cut into chunks, a run of markers and what follows
up to the next marker, each distinct chunk is segmented once, and the ids are joined back by position.

Defined cases: a null text is encoded as the empty text; null and repeated ids of documents are passed on as they are; an
empty table gives an empty result.  Columns other than the named ones are not read.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislemetrics.llm.common import Memo, map_rows

MARKER = "▁"
_CHUNK = re.compile(f"{MARKER}+[^{MARKER}]*")

_loaded: dict[str, object] = {}


def processor(model: str):
    """The library's processor of a model file, loaded once a process; refused where a piece crosses a marker."""
    if model not in _loaded:
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (loaded.id_to_piece(i) for i in range(loaded.get_piece_size()))
        if any(MARKER in piece.lstrip(MARKER) for piece in pieces):
            raise ValueError(f"{model}: a piece crosses a white-space marker")
        _loaded[model] = loaded
    return _loaded[model]


def chunk_ids(model: str) -> Memo:
    """The table of distinct chunks, filled by the library on first sight of a chunk."""
    library = processor(model)

    def segment(chunk: str) -> tuple[int, ...]:
        # The library puts one marker before every text, here the chunk's first.  A lone marker is no text.
        return tuple(library.encode(chunk[1:], num_threads=1)) if len(chunk) > 1 else (library.piece_to_id(MARKER),)

    return Memo(segment)


def encode_text(text: str, ids: Memo) -> list[int]:
    if not text:
        return []
    marked = MARKER + text.replace(" ", MARKER)
    return list(chain.from_iterable([ids[chunk] for chunk in _CHUNK.findall(marked)]))


def encode_decode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): all ids of every whole text, and the text decoded from them."""

    def start():
        library, table = processor(model), chunk_ids(model)

        def work(texts):
            encoded = [encode_text(text or "", table) for text in texts]
            ends = np.cumsum([0, *map(len, encoded)], dtype=np.int32)
            values = np.fromiter(chain.from_iterable(encoded), np.int32, int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            return [ids, [library.decode(item) for item in encoded]]

        return work

    return map_rows(docs, "ids array<int>, decoded string", [text_col], start)


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``encode_decode`` returns, and its columns ``more``."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )
