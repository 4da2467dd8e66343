"""Sets of word shingles as numpy arrays, for the tasks of near-duplicate operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WIDTH = 5
#: Bytes of text that are hashed in one go.
LOT = 1 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15
UPPER, SPACE = bytes(range(65, 91)), bytes(range(9, 14))
#: A-Z to lower case, white space to blanks.
PLAIN = bytes.maketrans(UPPER + SPACE, UPPER.lower() + b" " * len(SPACE))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _lots(texts: list[str | None]) -> Iterator[list[bytes]]:
    lot, size = [], 0
    for text in texts:
        lot.append((text or "").encode().translate(PLAIN))
        size += len(lot[-1])
        if size >= LOT:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def word_hashes(lot: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of texts with plain blanks, and where those of each text end.

    Each distinct word is hashed once, by its bytes.
    """
    lists = pc.split_pattern(pa.array(lot, pa.binary()), b" ")
    words, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
    full = pc.binary_length(words).to_numpy() > 0
    ends = np.concatenate([[0], np.cumsum(full)])[ends]
    coded = words.filter(pa.array(full)).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), U, len(coded.dictionary))
    return hashes[coded.indices.to_numpy()], ends


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Per text the sorted hashes of its distinct shingles of five words.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text of fewer words has them all as its
    one shingle; without words, or null, it has none.
    """
    for lot in _lots(texts):
        words, ends = word_hashes(lot)
        n = max(0, len(words) - WIDTH + 1)
        joined = np.zeros(n, U)
        for k in range(WIDTH):
            joined = joined * U(BASE) + words[k : k + n]
        joined = mix(joined)
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            if b - a >= WIDTH:
                yield np.unique(joined[a : b - WIDTH + 1])
            else:
                few = np.array([b - a], U)
                for k in range(a, b):
                    few = few * U(BASE) + words[k : k + 1]
                yield mix(few) if b > a else np.zeros(0, U)
