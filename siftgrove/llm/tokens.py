"""Arrow-side word splitting shared by the text operators: no Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_GAP = r"[^\pL\pN]+"


def as_array(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if isinstance(column, pa.Array) else column.chunk(0)


def words(texts: pa.Array, pattern: str = WORD_GAP) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row of each word, index of each word in the vocabulary, vocabulary), words in lower case, in text order."""
    parts = pc.split_pattern_regex(pc.fill_null(texts, ""), pattern)
    flat = as_array(parts.flatten())
    rows = np.asarray(pc.list_parent_indices(parts))
    coded = as_array(pc.utf8_lower(flat)).dictionary_encode()
    index = np.asarray(coded.indices)
    vocabulary = coded.dictionary.to_pylist()
    if "" in vocabulary:  # before the first and after the last word
        keep = index != vocabulary.index("")
        rows, index = rows[keep], index[keep]
    return rows, index, vocabulary
