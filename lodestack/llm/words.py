"""Words of text columns as codes, batch by batch: each distinct word of a batch is looked at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def word_codes(texts: pa.Array, code: Callable[[list[str]], np.ndarray], bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all ``texts`` in a row, and the number of words of each text.

    Words are what white space separates, in lower case; with ``bare`` all but letters and digits separates. ``code`` gives the codes of distinct words. A null text has none.
    """
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if bare:
        texts = pc.replace_substring_regex(texts, r"[^\pL\pN\s]+", " ")
    lists = pc.utf8_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    table = code(coded.dictionary.to_pylist())
    index = coded.indices.to_numpy()
    out = table[index] if len(table) else np.zeros(0, table.dtype)
    # white space at either end gives empty strings
    empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[index] if len(index) else np.zeros(0, bool)
    counts = np.diff(offsets)
    if empty.any():
        of = np.repeat(np.arange(len(counts)), counts)
        counts = counts - np.bincount(of[empty], minlength=len(counts))
        out = out[~empty]
    return out, counts
