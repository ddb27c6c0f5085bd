"""Problem 8: passages of evaluation items inside training text.

Seeds are word n-grams of the items: of every stretch of ``INTACT`` consecutive words the n-gram rarest among the items
is a seed, so any copy that leaves so many words in a row unchanged holds one; an item shorter than an n-gram is its own
seed. One pass over the documents looks the seeds up (word ids mixed to 64-bit numbers and compared in numpy) and every
(document, item) pair with a seed is scored by Smith-Waterman alignment of words. A pair is a leak by its alignment: the
score is worth at least ``EDITED`` of ``RUN`` equal words (of the whole item, if it is shorter), so edited and
paraphrased copies are leaks too. ``leaked_items`` keeps of these the pairs with ``RUN`` consecutive equal words.

The item side is sent to the executors in blocks of at most ``BLOCK_WORDS`` words (about 8 MB each); each block is one
pass over the documents, so time grows with the number of blocks (1 for the items here), memory doesn't.

Defined results: null or empty texts and items give no rows; repeated items or documents with one id count once.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import as_array, words

RUN = 12
GRAM = 6
#: Words in a row a copy must have left unchanged to be looked at; least worth of its alignment in shares of ``RUN`` words.
INTACT, EDITED = 8, 0.8
BLOCK_WORDS = 200_000
MATCH, MISMATCH, GAP = 2.0, -1.0, 1.0


class ItemIndex:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.word_id = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.items = {item: np.array([self.word_id[w] for w in ws], dtype=np.int64) for item, ws in items if ws}
        seen: Counter[int] = Counter()
        grams: dict[int, np.ndarray] = {}
        for item, ids in self.items.items():
            grams[item] = mixed(ids, min(GRAM, len(ids)))
            seen.update(set(grams[item].tolist()))
        #: size of the n-gram -> its number -> (item, place in the item)
        self.seeds: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item, ids in self.items.items():
            window = max(1, min(INTACT, len(ids)) - GRAM + 1)
            rarity = [seen[g] for g in grams[item].tolist()]
            for at in sorted({min(range(i, i + window), key=lambda p: (rarity[p], p)) for i in range(len(rarity) - window + 1)}):
                self.seeds[min(GRAM, len(ids))][int(grams[item][at])].append((item, at))
        self.seeds = {size: dict(places) for size, places in self.seeds.items()}
        self.keys = {size: np.array(sorted(places), dtype=np.int64) for size, places in self.seeds.items()}

    def pairs(self, rows: np.ndarray, ids: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(row, item) -> places (word in the batch, word in the item) where a seed is found."""
        found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        known = (ids > 0).astype(np.int8)
        for size, keys in self.keys.items():
            n = len(ids) - size + 1
            if n < 1:
                continue
            full = (rows[:n] == rows[size - 1 :]).astype(np.int8)
            for k in range(size):
                full &= known[k : n + k]
            at = np.flatnonzero(full)
            if not len(at):
                continue
            values = mixed(ids, size)[at]
            place = np.searchsorted(keys, values)
            place[place == len(keys)] = 0
            hit = keys[place] == values
            for i, value in zip(at[hit].tolist(), values[hit].tolist()):
                for item, pos in self.seeds[size][value]:
                    found[int(rows[i]), item].append((i, pos))
        return found


def mixed(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit number for each n-gram of a word sequence."""
    wide = ids.astype(np.uint64)
    out = np.zeros(max(0, len(ids) - size + 1), dtype=np.uint64)
    for k in range(size if len(out) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + wide[k : len(ids) - size + 1 + k]
    return out.view(np.int64)


def longest_run(text: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]]) -> int:
    """Most consecutive words that text and item share at one of the seeds."""
    best, seen = 0, set()
    for i, p in seeds:
        if (i - p, p) in seen:
            continue
        lo = 0
        while i - lo - 1 >= 0 and p - lo - 1 >= 0 and text[i - lo - 1] == item[p - lo - 1]:
            lo += 1
        hi = 0
        while i + hi < len(text) and p + hi < len(item) and text[i + hi] == item[p + hi]:
            hi += 1
        seen.update((i - p, q) for q in range(p - lo, p + hi))
        best = max(best, lo + hi) if hi else best
    return best


def align(text: np.ndarray, item: np.ndarray) -> float:
    """Smith-Waterman score of two word sequences, each row of the table in numpy; ``MATCH * len(item)`` is perfect."""
    if not len(text) or not len(item):
        return 0.0
    steps = GAP * np.arange(len(text) + 1)
    row, best = np.zeros(len(text) + 1), 0.0
    for word in item:
        new = np.zeros(len(text) + 1)
        new[1:] = np.maximum(row[:-1] + np.where(text == word, MATCH, MISMATCH), row[1:] - GAP)
        new = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + steps) - steps, 0)
        row, best = new, max(best, float(new.max()))
    return best


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """Items as words, in blocks; rows stream to the driver and only one block is held at a time."""
    block, size, seen = [], 0, set()
    for r in items.select("item_id", "item_text").dropna().toLocalIterator():
        if r.item_id in seen:
            continue
        seen.add(r.item_id)
        _, index, vocabulary = words(pa.array([r.item_text]))
        block.append((r.item_id, [vocabulary[i] for i in index.tolist()]))
        size += len(index)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leak_alignments(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, longest_run, item_words, alignment): every leak, exact or edited.

    ``alignment`` is the Smith-Waterman score in equal words (a word changed, left out or put in costs a half); the aligned
    region reaches an item's length to both sides of the seeds.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, longest_run int, item_words int, alignment double"

    def pass_of(block: list[tuple[int, list[str]]]) -> DataFrame:
        index = spark.sparkContext.broadcast(ItemIndex(block))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = index.value
            for batch in batches:
                rows, at, vocabulary = words(as_array(batch.column("text")))
                ids = np.array([items.word_id.get(w, 0) for w in vocabulary], dtype=np.int64)[at] if len(at) else np.zeros(0, np.int64)
                docs, out = batch.column("doc_id").to_pylist(), []
                for (row, item), seeds in items.pairs(rows, ids).items():
                    lo, hi = np.searchsorted(rows, row), np.searchsorted(rows, row, "right")
                    text, target = ids[lo:hi], items.items[item]
                    places = [(i - lo, p) for i, p in seeds]
                    longest = longest_run(text, target, places)
                    if not longest:  # two n-grams of one number
                        continue
                    a = max(0, min(i for i, _ in places) - len(target))
                    b = max(i for i, _ in places) + len(target)
                    score = align(text[a:b], target) / MATCH
                    if score >= EDITED * min(run, len(target)):
                        out.append((docs[row], item, longest, len(target), score))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], names=["doc_id", "item_id", "longest_run", "item_words", "alignment"])

        return documents.select("doc_id", "text").mapInArrow(look, schema)

    passes = [pass_of(block) for block in _blocks(items)]
    if not passes:
        return spark.createDataFrame([], schema)
    best = reduce(DataFrame.unionByName, passes).groupBy("doc_id", "item_id").agg(F.max(F.struct("alignment", "longest_run", "item_words")).alias("m"))
    return best.select("doc_id", "item_id", "m.longest_run", "m.item_words", "m.alignment")


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id): of all leaks those with ``run`` consecutive words of the item, or the whole of a shorter item."""
    return leak_alignments(documents, items, run).filter(f"longest_run >= least({run}, item_words)").select("doc_id", "item_id")


def leaked_documents(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, n_items, n_edited, best_alignment): documents with leaked items, how many in all and how many edited only."""
    hits = leak_alignments(documents, items, run)
    edited = F.col("longest_run") < F.least(F.lit(run), F.col("item_words"))
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(edited).alias("n_edited"), F.max("alignment").alias("best_alignment"))
