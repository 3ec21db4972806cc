"""Evaluation items inside corpus documents, found by spaced-seed hashing and verified with substitutions allowed.

Both sides become sequences of words without case, punctuation and marks.  A seed is a mask over neighbouring words that
ignores some positions; the words at its other positions are hashed.  ``MASKS`` is lossless: for any two changed words
of twenty, and any three of thirty, some mask fits beside the changes (tested exhaustively), and a longer passage with
one word in ten changed always contains a passage of twenty to thirty-nine words with that property.  A hit fixes the
alignment of document and item; along it the longest run with at most one word in ten changed is looked for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Offsets of the words that each seed hashes.
MASKS = ((0, 1, 3, 5, 6, 7, 8, 10), (0, 1, 4, 5, 7, 8, 9, 10), (0, 1, 2, 3, 4, 5, 6, 8), (0, 1, 4, 5, 6, 7, 8, 9))
#: Words a passage must have, and how many words may hold one change.
LEAST_WORDS, PER_CHANGE = 20, 10
#: Items that are matched in one pass over the documents; more items take more passes.
ITEMS_PER_PASS = 20_000
#: Characters of the items of one pass, if these come first.
ITEM_CHARS_PER_PASS = 20_000_000

_NOISE = re.compile(r"[^\w\s]+|_+")


def words_of(text: str | None) -> list[str]:
    """Words between blanks without case, punctuation and marks; words of nothing else vanish."""
    return _NOISE.sub("", unicodedata.normalize("NFKD", text).casefold()).split() if text else []


def longest_passage(same: np.ndarray, least: int = LEAST_WORDS, per_change: int = PER_CHANGE) -> int:
    """Length of the longest run in a 0/1 array with at most one 0 in ``per_change``, or 0 if none has ``least`` places."""
    n = len(same)
    if n < least:
        return 0
    # position j ends a good run from i if cost[j] <= cost[i], with cost rising by per_change - 1 per change, falling by 1 per match
    cost = np.concatenate([[0], np.cumsum(np.where(same, -1, per_change - 1))])
    # the last such j is the last place from which on the least cost is that low
    rest = np.minimum.accumulate(cost[::-1])[::-1]
    i = np.arange(n - least + 1)
    longest = int((np.searchsorted(rest, cost[i], side="right") - 1 - i).max())
    return longest if longest >= least else 0


class ItemIndex:
    """Seeds of a block of items: hash -> (item, position), for each mask."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.keys = [i for i, _ in items]
        self.words: dict[str, int] = {}
        self.seq = [np.array([self.words.setdefault(w, len(self.words) + 1) for w in words_of(t)], dtype=np.int64) for _, t in items]
        rng = np.random.default_rng(20)
        self.mult = [int(x) | 1 for x in rng.integers(1, 2**62, size=max(map(len, MASKS)))]
        self.seeds = []
        for mask in MASKS:
            found = [(h, k, p) for k, s in enumerate(self.seq) for p, h in zip(*self._hashes(s, mask), strict=True)]
            found.sort()
            self.seeds.append((np.array([f[0] for f in found], dtype=np.int64), np.array([f[1] for f in found], dtype=np.int64), np.array([f[2] for f in found], dtype=np.int64)))

    def _hashes(self, seq: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes at which all masked words are known."""
        n = len(seq) - mask[-1]
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        ok = np.ones(n, dtype=bool)
        h = np.zeros(n, dtype=np.int64)
        with np.errstate(over="ignore"):
            for o, m in zip(mask, self.mult, strict=False):
                part = seq[o : o + n]
                ok &= part > 0
                h += part * np.int64(m)
                h ^= h >> 29
        at = np.flatnonzero(ok)
        return at, h[at]

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(row, item place, words) for every text that holds a passage of an item."""
        get = self.words.get
        seqs = [np.array([get(w, 0) for w in words_of(t)], dtype=np.int64) for t in texts]
        gap = np.zeros(max(m[-1] for m in MASKS) + 1, dtype=np.int64)
        flat = np.concatenate([x for s in seqs for x in (s, gap)]) if seqs else gap
        starts = np.cumsum([0, *[len(s) + len(gap) for s in seqs]])[:-1]
        pairs: set[tuple[int, int, int]] = set()
        for mask, (hashes, item, place) in zip(MASKS, self.seeds, strict=True):
            at, h = self._hashes(flat, mask)
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            for a, x, y in zip(at[hit := low < high], low[hit], high[hit], strict=True):
                row = int(np.searchsorted(starts, a, side="right")) - 1
                for k in range(x, y):
                    pairs.add((row, int(item[k]), int(a - starts[row] - place[k])))
        best: dict[tuple[int, int], int] = {}
        for row, k, shift in pairs:
            doc, own = seqs[row], self.seq[k]
            a, b = max(0, -shift), min(len(own), len(doc) - shift)
            n = longest_passage(doc[a + shift : b + shift] == own[a:b])
            if n >= LEAST_WORDS:
                best[row, k] = max(n, best.get((row, k), 0))
        return [(row, k, n) for (row, k), n in best.items()]


def leaked_items(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, words): each document that holds at least twenty consecutive words of an item, one in ten changed.

    The items are a stated query set: they are read in blocks of ``ITEMS_PER_PASS`` or ``ITEM_CHARS_PER_PASS``, each matched against all documents
    in one pass without a shuffle.  Every repeated document counts; NULL, empty and shorter texts and items match
    nothing; texts of any length are searched whole; items with equal texts are each reported; repeated item rows once.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(f"`{doc_key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    kinds = rows.schema["key"].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{doc_key}` {kinds[0]}, `{item_key}` {kinds[1]}, words int"
    out, block, size = None, [], 0

    def matched(block: list[tuple[int, str]]) -> DataFrame:
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in batches:
                index = index or ItemIndex(held.value)
                for low in range(0, batch.num_rows, 1_000):
                    part = batch.slice(low, 1_000)
                    found = sorted(index.search(part.column(1).to_pylist()))
                    if found:
                        keys = part.column(0).take(pa.array([f[0] for f in found]))
                        arrays = [keys, pa.array([index.keys[f[1]] for f in found]), pa.array([f[2] for f in found], pa.int32())]
                        yield pa.RecordBatch.from_arrays(arrays, names=[doc_key, item_key, "words"])

        return rows.mapInArrow(run, schema)

    for item in items.select(item_key, text).where(F.col(text).isNotNull()).distinct().toLocalIterator():
        block.append((item[0], item[1]))
        size += len(item[1])
        if len(block) >= ITEMS_PER_PASS or size >= ITEM_CHARS_PER_PASS:
            out, block, size = matched(block) if out is None else out.unionByName(matched(block)), [], 0
    if block or out is None:
        out = matched(block) if out is None else out.unionByName(matched(block))
    return out
