"""Words of whole texts as arrays of numbers, a bounded slice of a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once (one longer text is a slice of its own).
SLICE = 4 << 20


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(begin, end) of consecutive rows that hold at most ``size`` bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, "right")))
        yield begin, end
        begin = end


def ascii_words(texts: pa.Array) -> pa.ListArray:
    """Each text's runs of anything but ASCII white space, with A-Z in lower case; blank texts give one empty word."""
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))


def letter_words(texts: pa.Array) -> pa.ListArray:
    """Each text's runs of letters and digits, in lower case; texts without any give one empty word."""
    return ascii_words(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN]+", " "))


def hashed(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, ends of each text's words); empty words are left out."""
    coded = words.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
    each = pd.util.hash_array(names, categorize=False) if len(names) else np.empty(0, np.uint64)
    starts = words.offsets.to_numpy()
    starts = starts - starts[0]
    real = (names != "")[codes] if len(names) else np.empty(0, bool)
    return each[codes[real]], np.append(0, np.cumsum(real))[starts[1:]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
