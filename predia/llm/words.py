"""Words of many texts at once: byte classes in numpy, distinct words by Arrow's dictionary encoding.

All breaks are ASCII bytes, which never occur inside a longer UTF-8 sequence, so bytes may be classed
one by one. A-Z are lowered, nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(pattern: bytes) -> np.ndarray:
    """True for each byte value that the character class matches."""
    one = re.compile(pattern)
    return np.array([bool(one.fullmatch(bytes([b]))) for b in range(256)])


def slices(text: bytes, stop: re.Pattern[bytes], most: int) -> Iterator[bytes]:
    """A text cut behind `most` bytes, but only at a break, which is left out."""
    at = 0
    while len(text) - at > most and (found := stop.search(text, at + most)):
        yield text[at:found.start()]
        at = found.end()
    yield text[at:] if at else text


class Words:
    """Words of the given parts, in order: `ids` into `distinct`, `part` each stands in, `starts` as bytes."""

    def __init__(self, parts: list[bytes], is_word: np.ndarray):
        self.flat = flat = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        inside = is_word[flat]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        self.starts, ends = edges[0::2], edges[1::2]
        offsets = np.zeros(len(ends) + 1, np.int32)
        np.cumsum(ends - self.starts, out=offsets[1:])
        letters = LOWER[flat[inside]]
        found = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        self.ids = found.indices.to_numpy()
        self.distinct: pa.BinaryArray = found.dictionary
        bounds = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        self.counts = np.diff(np.searchsorted(self.starts, bounds), prepend=0)
        self.part = np.repeat(np.arange(len(parts)), self.counts)
