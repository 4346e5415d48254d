"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased and stripped of all but letters and digits.  A document is
contaminated by an item if the best local alignment, word by word with +1 for
equal words and -1 for others and for gaps, scores ``threshold`` of the item's
words or more, and ``LEAST_MATCH`` (or all words of a shorter item): less than
that is found anywhere.

Seeds lose no such document.  An alignment that scores T has runs of equal words
with an error between any two, so its runs hold T - 1 pairs of successive words
or more.  Of an item's L - 1 pairs any L - T + 1 hence include one that the
document holds: those that the fewest documents hold (counted over all) are the
seeds, and the T - 2 most frequent ones fetch nothing.  Such an alignment has at
most L - T errors, which bounds the passage around a seed that it can lie in; the
passage is aligned if it holds T - 1 of the item's pairs.

Test items are a stated query set: they go out with the tasks in blocks of at
most ``block_items`` items and ``block_words`` words, each block against all
rows.  Documents stay where they are: no shuffle, no join, one row at a time.

Defined cases: null or empty texts and items match nothing; rows, equal ones too,
are judged one by one; an item given twice is reported twice; of equally good
passages the first counts; very long texts are read whole, as one row; an empty
table gives an empty result, and without items nothing is contaminated; extra
columns are carried along, whatever their names (``contamination`` is replaced).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import carried
from evigraph.llm.wordhash import grams, plain_words, trim

LEAST_MATCH = 4
FOUND = "array<struct<item_id: long, score: double, begin: int, end: int>>"


def least_score(n_words: int, threshold: float) -> int:
    """The least whole score that counts as found."""
    return max(math.ceil(threshold * n_words - 1e-9), min(n_words, LEAST_MATCH), 1)


def gram_size(least: int) -> int:
    """A score of one needs no more than a word."""
    return 2 if least >= 2 else 1


@dataclass
class Index:
    """Grams of one size in order, and the places ``first[k]`` to ``first[k + 1]`` that hold the k-th."""

    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seed: np.ndarray

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The hashes, and a bitmap of their low bits that few others pass."""
        bits = np.zeros(1 << 20, bool)
        bits[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return self.keys, bits


@dataclass
class Items:
    """A block of test items, with their grams by the gram's number of words."""

    ids: list
    words: list[np.ndarray]
    least: np.ndarray
    index: dict[int, Index]

    def tables(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {n: x.table() for n, x in self.index.items()}


def spots(text_grams: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Places whose gram is in the table."""
    keys, bits = table
    maybe = np.flatnonzero(bits[(text_grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
    if not len(maybe):
        return maybe
    at = np.searchsorted(keys, text_grams[maybe])
    return maybe[keys[np.minimum(at, len(keys) - 1)] == text_grams[maybe]]


def all_grams(ids: list, texts: list[str | None], threshold: float) -> Items:
    words = list(plain_words(pa.array(texts, pa.string())))
    least = np.array([least_score(len(w), threshold) for w in words], np.int64)
    index = {}
    for n in sorted({gram_size(t) for w, t in zip(words, least, strict=True) if len(w)}):
        own = [(i, grams(w, n)) for i, w in enumerate(words) if len(w) and gram_size(least[i]) == n]
        every = np.concatenate([g for _, g in own])
        order = np.argsort(every, kind="stable")
        keys, first = np.unique(every[order], return_index=True)
        item = np.concatenate([np.full(len(g), i) for i, g in own])[order]
        place = np.concatenate([np.arange(len(g)) for _, g in own])[order]
        index[n] = Index(keys, np.append(first, len(every)), item, place, np.zeros(len(every), bool))
    return Items(ids, words, least, index)


def count_documents(docs: DataFrame, items: Items, text: str) -> dict[tuple[int, int], int]:
    """In how many documents each n-gram of the items occurs: at most one row an n-gram comes to the driver."""
    tables = items.tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: np.zeros(len(keys), np.int64) for n, (keys, _) in tables.items()}
        for batch in batches:
            for w in plain_words(batch.column(0)):
                for n, table in tables.items():
                    g = grams(w, n)
                    hit = spots(g, table) if len(g) else g
                    if len(hit):
                        sums[n][np.unique(np.searchsorted(table[0], g[hit]))] += 1
        for n, s in sums.items():
            held = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), n, np.int32)), pa.array(held), pa.array(s[held])], names=["n", "at", "docs"])
        trim()

    rows = docs.select(text).mapInArrow(run, "n int, at long, docs long").groupBy("n", "at").agg(F.sum("docs").alias("docs")).collect()
    return {(r["n"], r["at"]): r["docs"] for r in rows}


def rare_seeds(items: Items, docs_with: dict[tuple[int, int], int]) -> Items:
    """Marks L - T + 1 places of each item, those whose grams the fewest documents hold."""
    index = {}
    for n, x in items.index.items():
        held = np.array([docs_with.get((n, k), 0) for k in range(len(x.keys))], np.int64)
        held = np.repeat(held, np.diff(x.first))
        order = np.lexsort((x.place, held, x.item))
        starts = np.flatnonzero(np.diff(x.item[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        lengths = np.array([len(w) for w in items.words])
        seed = np.zeros(len(order), bool)
        seed[order] = rank <= (lengths - items.least)[x.item[order]]
        index[n] = Index(x.keys, x.first, x.item, x.place, seed)
    return Items(items.ids, items.words, items.least, index)


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local score and the end of its alignment in the passage."""
    width = len(passage)
    steps = np.arange(width)
    above = np.zeros(width + 1, np.int64)
    best, end = 0, 0
    for word in item:
        row = np.maximum(above[:-1] + np.where(passage == word, 1, -1), above[1:] - 1)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + steps) - steps  # gaps in the item
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top + 1
        above[1:] = row
    return best, end


def passages(starts: list[int], length: int, errors: int, n_words: int) -> list[tuple[int, int]]:
    """Stretches of a text in which an item that seems to start there may lie, with so many errors."""
    out: list[tuple[int, int]] = []
    for s in sorted(set(starts)):
        a, b = max(0, s - errors), min(n_words, s + length + errors)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def places(words: np.ndarray, items: Items, tables: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, list[int]]:
    """By item, where in the text it seems to start: at seeds with enough of its grams around them."""
    starts: dict[int, list[int]] = {}
    for n, table in tables.items():
        g = grams(words, n)
        p = spots(g, table) if len(g) else g
        if not len(p):
            continue
        x = items.index[n]
        at = np.searchsorted(x.keys, g[p])
        many = x.first[at + 1] - x.first[at]
        row = np.arange(many.sum()) + np.repeat(x.first[at] - (np.cumsum(many) - many), many)
        p, item, seed = np.repeat(p, many), x.item[row], x.seed[row]
        counts = np.bincount(item, minlength=len(items.ids))
        fetched = np.unique(item[seed])
        for i in fetched[counts[fetched] >= items.least[fetched] - n + 1].tolist():
            shared = items.least[i] - n + 1
            own, length = item == i, len(items.words[i])
            begin = (p - x.place[row])[own & seed]
            held = np.unique(p[own])
            errors = length - items.least[i]
            near = np.searchsorted(held, begin + length + errors) - np.searchsorted(held, begin - errors)
            # an alignment uses each place of the text once
            if (begin := begin[near >= shared]).size:
                starts[i] = begin.tolist()
    return starts


def examine(words: np.ndarray, items: Items, tables: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
    out = []
    for i, at in sorted(places(words, items, tables).items()):
        item, least = items.words[i], int(items.least[i])
        best = (0, 0, 0)
        for a, b in passages(at, len(item), len(item) - least, len(words)):
            score, end = smith_waterman(item, words[a:b])
            if score > best[0]:
                best = (score, a, a + end)
        score, a, end = best
        if score >= least:
            _, back = smith_waterman(item[::-1], words[a:end][::-1])
            out.append((items.ids[i], score / len(item), end - back, end))
    return out


def blocks(items: DataFrame, item_id: str, text: str, block_items: int, block_words: int) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for row in items.select(item_id, text).toLocalIterator():
        n = len((row[1] or "").split())
        if ids and (len(ids) >= block_items or size + n > block_words):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0]), texts.append(row[1])
        size += n
    if ids:
        yield ids, texts


def annotate(docs: DataFrame, items: DataFrame, threshold: float = 0.4, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_items: int = 5000, block_words: int = 400_000) -> DataFrame:
    """Adds ``contamination``: for each item found, its id, score (share of its words) and the words' range in the text."""
    out = docs.select(*carried(docs, "contamination"), F.array().cast(FOUND).alias("contamination"))
    for ids, texts in blocks(items, item_id, item_text, block_items, block_words):
        every = all_grams(ids, texts, threshold)
        chosen = rare_seeds(every, count_documents(docs, every, text))
        out = out.withColumn("contamination", F.concat("contamination", _examiner(chosen)(F.col(text))))
    return out


def _examiner(chosen: Items):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = chosen.tables()
        for texts in batches:
            found = (examine(words, chosen, tables) for words in plain_words(texts))
            yield pa.array([[{"item_id": i, "score": s, "begin": b, "end": e} for i, s, b, e in hits] for hits in found], kind)
        trim()

    return F.arrow_udf(run, FOUND)


def pairs(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row for each document and item found in it."""
    found = annotate(docs, items, **options).select("doc_id", F.explode("contamination").alias("c"))
    return found.select("doc_id", "c.item_id", F.round("c.score", 6).alias("score"), F.col("c.begin").alias("begin_word"), F.col("c.end").alias("end_word"))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no item."""
    return annotate(docs, items, **options).where(F.size("contamination") == 0).drop("contamination")
