"""Words of many texts as numbers, by Arrow's own kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def coded_words(texts: pa.Array, letters: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, code, terms): for each word in order its text and its number among the sorted terms.

    ``letters`` says for each byte what it becomes, a space where it belongs to no word; bytes beyond
    ASCII must stay, so that texts stay UTF-8.
    """
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = memoryview(raw.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    spaced = pa.py_buffer(bytes(data).translate(letters))
    plain = pa.Array.from_buffers(pa.large_string(), len(raw), [None, pa.py_buffer(offsets - offsets[0]), spaced])
    split = pc.ascii_split_whitespace(plain)
    words, sizes = split.flatten(), np.diff(split.offsets.to_numpy())
    some = pc.greater(pc.binary_length(words), 0)
    text = np.repeat(np.arange(len(raw)), sizes)[some.to_numpy(zero_copy_only=False)]
    numbered = words.filter(some).dictionary_encode()
    order = pc.sort_indices(numbered.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return text, rank[numbered.indices.to_numpy()], numbered.dictionary.take(order)
