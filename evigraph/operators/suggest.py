"""Names like those that weren't found, by matching blocks.

Two names' ratio is twice the number of characters in matching blocks over the
number of all characters; blocks are the longest common stretch, and so on to
the left and right of it.  Blocks stand in the same order in both names, so no
more characters match than the longest common subsequence has.  Blocks of names
meet blocks of names asked for, a task a pair of blocks: lengths of subsequences
are worked out for a whole block at a time, on bits, and only pairs that can be
among the best of their block are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from heapq import heappushpop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names, and names asked for, that meet in one task; and characters of either that it holds.
NAMES, ASKED, CHARACTERS = 8192, 128, 2_000_000
#: Characters of a name asked for that one word of bits holds.
BITS = 64


class _Letters:
    """Names in the order of their lengths, as numbers of letters one after the other."""

    def __init__(self, names: list[str]):
        self.names = sorted(names, key=len)
        self.lengths = np.array([len(n) for n in self.names], dtype=np.int64)
        self.start = np.cumsum(self.lengths) - self.lengths
        letters, self.codes = np.unique(np.frombuffer("".join(self.names).encode("utf-32-le"), dtype=np.uint32), return_inverse=True)
        self.place = {chr(c): i for i, c in enumerate(letters)}

    def in_common(self, wanted: str, low: int, high: int) -> np.ndarray:
        """The most characters that each of the names low to high - 1 and the wanted one can match: lengths of common subsequences.

        A longer name is taken in pieces, whose lengths add up to no less than the whole's.
        """
        total = np.zeros(high - low, dtype=np.int64)
        for at in range(0, len(wanted), BITS):
            masks = np.zeros(len(self.place), dtype=np.uint64)
            for bit, letter in enumerate(wanted[at : at + BITS]):
                if letter in self.place:
                    masks[self.place[letter]] |= np.uint64(1 << bit)
            left = np.full(high - low, np.iinfo(np.uint64).max, dtype=np.uint64)  # a bit falls with each character matched
            for j in range(int(self.lengths[high - 1])):
                first = max(int(np.searchsorted(self.lengths, j, side="right")), low)  # shorter names are through
                row = left[first - low :]
                hit = row & masks[self.codes[self.start[first:high] + j]]
                left[first - low :] = (row + hit) | (row - hit)
            total += np.bitwise_count(~left)
        return np.minimum(total, np.minimum(self.lengths[low:high], len(wanted)))


def _best(letters: _Letters, wanted: str, most: int, cutoff: float) -> list[tuple[float, str]]:
    """The ``most`` greatest (ratio, name) of the cutoff or more; pairs are compared from the greatest bound down, until no bound reaches the last kept."""
    # 2 min(m, n) / (m + n) must reach the cutoff, so shorter and longer names are left out
    m = len(wanted)
    low = int(np.searchsorted(letters.lengths, int(m * cutoff / (2 - cutoff)), side="left"))
    high = int(np.searchsorted(letters.lengths, int(m * (2 - cutoff) / cutoff) + 1, side="right"))
    if low >= high:
        return []
    # the same arithmetic as the ratio's, so that a bound is never below it
    bound = 2.0 * letters.in_common(wanted, low, high) / (letters.lengths[low:high] + m)
    matcher, kept = SequenceMatcher(), []
    matcher.set_seq2(wanted)
    near = np.flatnonzero(bound >= cutoff)
    for i in near[np.argsort(-bound[near], kind="stable")]:
        if len(kept) == most and bound[i] < kept[0][0]:
            break
        name = letters.names[low + i]
        matcher.set_seq1(name)
        ratio = matcher.ratio()
        if ratio >= cutoff:
            heappush(kept, (ratio, name)) if len(kept) < most else heappushpop(kept, (ratio, name))
    return kept


def _dealt(names: DataFrame, block: str, blocks: int, other: str, others: int) -> DataFrame:
    """Names with their block, once for each block of the other side."""
    own = F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int").alias(block)
    return names.select("x", own, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))


def suggestions(names: DataFrame, wanted: DataFrame, name: str = "name", most: int = 5, cutoff: float = 0.45) -> DataFrame:
    """(wanted, name, ratio, rank): for each name asked for (column ``wanted``) the ``most`` names of the greatest ratio, ties by name, descending.

    Null and empty names are like none; a name that occurs more than once counts once.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("the cutoff must be above 0 and at most 1")
    known = names.select(F.col(name).alias("x")).where("x <> ''").distinct()
    asked = wanted.select(F.col("wanted").alias("x")).where("x <> ''").distinct()
    size = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("x").cast("long")), F.lit(0)).alias("c")).first()
    pieces = lambda s, many: max(1, -(-s["n"] // many), -(-s["c"] // CHARACTERS))
    i, j = pieces(size(asked), ASKED), pieces(size(known), NAMES)
    # tasks by the number of blocks: by bytes, all of them would be one task
    met = _dealt(asked, "i", i, "j", j).withColumn("wanted", F.lit(True)).unionByName(_dealt(known, "j", j, "i", i).withColumn("wanted", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).to_pydict()
        words = [x for x, w in zip(table["x"], table["wanted"], strict=True) if w]
        others = [x for x, w in zip(table["x"], table["wanted"], strict=True) if not w]
        if not words or not others:
            return
        letters = _Letters(others)
        found = [(w, n, r) for w in words for r, n in _best(letters, w, most, cutoff)]
        yield pa.RecordBatch.from_pydict({"wanted": [f[0] for f in found], "name": [f[1] for f in found], "ratio": [f[2] for f in found]}, schema=pa.schema([("wanted", pa.string()), ("name", pa.string()), ("ratio", pa.float64())]))

    rated = met.repartition(i * j, "i", "j").groupBy("i", "j").applyInArrow(run, "wanted string, name string, ratio double")
    rank = F.row_number().over(Window.partitionBy("wanted").orderBy(F.desc("ratio"), F.desc("name")))
    return rated.withColumn("rank", rank).where(F.col("rank") <= most)
