"""Word hashes for operators that work in numpy: whole batches of texts at once, from their bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at a time; longer words are taken whole.
STRETCH = 1 << 19
SEPARATOR, DROPPED, KEPT = 0, 1, 2


def trim() -> None:
    """Gives freed memory back to the system: workers live on from task to task, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Odd multipliers of the places in a gram.
PLACES = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF | 1) for i in range(16)]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer: every bit of the result depends on every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:m] * PLACES[0]
        for i in range(1, n):
            h = (h ^ (h >> np.uint64(29))) * PLACES[i] + words[i : i + m]
    return mix64(h)


def _random(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


class Words:
    """How bytes make words: which separate, which are dropped, and what the others count as."""

    def __init__(self, separators: bytes, dropped: bytes = b""):
        self.role = np.full(256, KEPT, np.uint8)
        self.role[list(dropped)] = DROPPED
        self.role[list(separators)] = SEPARATOR
        lower = np.arange(256)
        lower[65:91] += 32
        self.value = _random(256, 1)[lower]
        self.place = _random(256, 2)

    def of_stretch(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words in these bytes, and where each begins; ``starts`` are places where a word ends anyway."""
        role = self.role[data]
        inside = role != SEPARATOR
        kept = np.flatnonzero(role == KEPT)
        if not len(kept):
            return np.empty(0, np.uint64), kept
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[starts] = inside[starts]
        run = np.cumsum(first, dtype=np.int32)[kept]
        begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        many = np.diff(np.append(begin, len(kept)))
        if many.max() > len(self.place):
            self.place = _random(2 * int(many.max()), 2)
        at = np.arange(len(kept), dtype=np.int64) - np.repeat(begin, many)
        with np.errstate(over="ignore"):
            return mix64(np.add.reduceat(self.value[data[kept]] * self.place[at], begin)), kept[begin]

    def of_texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The words' hashes of each text; none for null."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if not len(texts):
            return
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, offsets, body = texts.buffers()
        ends = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
        hashes, places, done = [], [], 0
        at, last, text = int(ends[0]), int(ends[-1]), 0
        while text < len(texts):
            # a stretch ends with a text, or inside a long one at a separator
            stop = int(ends[np.searchsorted(ends, at + STRETCH, "right") - 1])
            if stop <= at and at < last:
                end = int(ends[text + 1])
                stop = min(end, at + STRETCH)
                while stop < end:
                    gap = np.flatnonzero(self.role[data[stop : min(end, stop + STRETCH)]] == SEPARATOR)
                    if len(gap):
                        stop += int(gap[0])
                        break
                    stop = min(end, stop + STRETCH)
            if stop > at:
                inner = ends[np.searchsorted(ends, at) : np.searchsorted(ends, stop)] - at
                h, p = self.of_stretch(data[at:stop], inner)
                hashes.append(h), places.append(p + at)
                at = stop
            done = int(np.searchsorted(ends, at, "right")) - 1 if at < last else len(texts)
            if done > text:
                h, p = (np.concatenate([np.empty(0, t), *x]) if len(x) != 1 else x[0] for x, t in ((hashes, np.uint64), (places, np.int64)))
                cut = np.searchsorted(p, ends[text : done + 1])
                for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    yield h[x:y]
                hashes, places, text = [], [], done


#: A-Z lower-cased, ASCII white space between words.
RAW = Words(b" \t\n\v\f\r")
_OTHER = bytes(i for i in range(128) if not chr(i).isalnum())
_PLAIN = Words(b" \t\n\v\f\r\x1c\x1d\x1e\x1f", _OTHER)
#: Unicode's white space beyond ASCII, and what is neither ASCII nor a letter, number or white space.
SPACES = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SIGNS = r"[^\p{L}\p{N}\x00-\x7f]+"


def raw_words(texts: pa.Array) -> Iterator[np.ndarray]:
    """Words between ASCII white space, A-Z lower-cased."""
    return RAW.of_texts(texts)


def plain_words(texts: pa.Array) -> Iterator[np.ndarray]:
    """Words between white space, lower-cased, of letters and digits only."""
    ascii_ = pc.fill_null(pc.string_is_ascii(texts), True)
    if not pc.all(ascii_).as_py():
        changed = pc.utf8_lower(pc.replace_substring_regex(pc.replace_substring_regex(texts.filter(pc.invert(ascii_)), SPACES, " "), SIGNS, ""))
        texts = pc.replace_with_mask(texts, pc.invert(ascii_), changed)
    return _PLAIN.of_texts(texts)
