"""Token ids of whole corpora in a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's own pattern.  The distinct words of a batch go to DuckDB, which merges all
of them at once by one recursive query: rows (word, position, token) meet the merge table, every word contracts its
pair of least rank wherever it occurs from the left, and a word leaves the recursion when none of its pairs merges.
Words are kept for later batches of the same task in a table of bounded size; the ids of a text are put together from
its words.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files.
TOKENIZER_DIR = "/opt/tokenizers"
#: Distinct words that one task keeps between batches; when more have come up it starts anew.
CACHED_WORDS = 400_000

# Fixed value: the vocabulary's cut into words.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes up to which a word contracts one pair a step; longer ones contract the pair wherever it occurs, so their steps are bounded by the merges they use.
SHORT = 48

# Both recursions keep every step of a word; the last one is told by its step number.
_LAST = """
SELECT word, list(tok ORDER BY pos) AS ids, any_value(last) AS last
FROM (SELECT *, max(step) OVER (PARTITION BY word) AS last FROM state) WHERE step = last GROUP BY word
"""
_MERGE_SHORT = """
WITH RECURSIVE state(word, pos, tok, step) AS (
    SELECT word, pos, tok, 0 FROM start
  UNION ALL
    (WITH paired AS (SELECT word, pos, tok, step, lead(tok) OVER w AS nxt, lag(pos) OVER w AS before FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)),
      least AS (SELECT p.*, min((m.id::BIGINT << 24) | p.pos) OVER (PARTITION BY p.word) AS best FROM paired p LEFT JOIN merges m ON p.tok = m.l AND p.nxt = m.r)
    SELECT word, pos, CASE WHEN pos = best & 16777215 THEN (best >> 24)::INTEGER ELSE tok END, step + 1 FROM least WHERE best IS NOT NULL AND step < $most AND before IS DISTINCT FROM best & 16777215)
)
""" + _LAST
_MERGE_LONG = """
WITH RECURSIVE state(word, pos, tok, step) AS (
    SELECT word, pos, tok, 0 FROM start
  UNION ALL
    (WITH paired AS (SELECT word, pos, tok, step, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt FROM state),
      ranked AS (SELECT p.word, p.pos, p.tok, p.step, m.id FROM paired p LEFT JOIN merges m ON p.tok = m.l AND p.nxt = m.r),
      least AS (SELECT word, pos, tok, step, best, coalesce(id = best, FALSE) AS hit FROM (SELECT *, min(id) OVER (PARTITION BY word) AS best FROM ranked) WHERE best IS NOT NULL AND step < $most),
      runs AS (SELECT *, pos - row_number() OVER (PARTITION BY word, hit ORDER BY pos) AS run FROM least),
      taken AS (SELECT *, hit AND row_number() OVER (PARTITION BY word, hit, run ORDER BY pos) % 2 = 1 AS takes FROM runs),
      eaten AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY word ORDER BY pos), FALSE) AS gone FROM taken)
    SELECT word, (row_number() OVER (PARTITION BY word ORDER BY pos))::INTEGER, CASE WHEN takes THEN best ELSE tok END, step + 1 FROM eaten WHERE NOT gone)
)
""" + _LAST


def merge_table(ranks_file: str | Path) -> tuple[dict[int, int], pa.Table]:
    """Ids of the single bytes, and the merges (l, r, id) of a vocabulary given as ranks of byte strings.

    A token is merged from the two parts into which the merges of lower rank divide it.
    """
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(ranks_file).read_bytes().splitlines() if line)}
    left, right, merged = [], [], []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        left.append(ranks[parts[0]])
        right.append(ranks[parts[1]])
        merged.append(rank)
    return {k[0]: v for k, v in ranks.items() if len(k) == 1}, pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "id": pa.array(merged, pa.int32())})


class WordMerger:
    """Ids of words, merged by DuckDB in groups and kept up to ``CACHED_WORDS``."""

    def __init__(self, byte_ids: dict[int, int], merges: pa.Table) -> None:
        import duckdb

        self.of_byte = np.zeros(256, dtype=np.int32)
        self.of_byte[list(byte_ids)] = list(byte_ids.values())
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.db.register("merges_arrow", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_arrow")
        self.known: dict[str, list[int]] = {}

    def learn(self, words: set[str], group: int = 20_000, most_bytes: int = 400_000) -> None:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        coded = [w.encode() for w in new]
        for short in (True, False):
            part, size = [], 0
            for k, c in enumerate(coded):
                if (len(c) <= SHORT) == short:
                    part.append(k)
                    size += len(c)
                    if len(part) == group or size >= most_bytes:
                        self._merge([new[i] for i in part], [self.of_byte[np.frombuffer(coded[i], dtype=np.uint8)] for i in part], short)
                        part, size = [], 0
            if part:
                self._merge([new[i] for i in part], [self.of_byte[np.frombuffer(coded[i], dtype=np.uint8)] for i in part], short)

    def _merge(self, names: list[str], ids: list[np.ndarray], short: bool) -> None:
        while names:
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            # steps of one query are bounded, as it keeps them all; words that need more go on from where it ended
            most = max(4, 3_000_000 // max(1, int(sizes.sum())))
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            self.db.register("start", pa.table({"word": pa.array(np.repeat(np.arange(len(ids), dtype=np.int32), sizes)), "pos": pa.array(place.astype(np.int32)), "tok": pa.array(np.concatenate(ids))}))
            done = self.db.sql(_MERGE_SHORT if short else _MERGE_LONG, params={"most": most}).to_arrow_table()
            self.db.unregister("start")
            left = []
            for k, found, last in zip(done.column(0).to_pylist(), done.column(1).to_pylist(), done.column(2).to_pylist(), strict=True):
                if last < most:
                    self.known[names[k]] = found
                else:
                    left.append((names[k], np.array(found, dtype=np.int32)))
            names, ids = [n for n, _ in left], [i for _, i in left]


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", ranks_file: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens; strings of special tokens are ordinary text.

    A NULL text and an empty one both give an empty list; a blank text gives the ids of its blanks.  Texts of any length
    are encoded whole; repeated rows give repeated results; a NULL key stays; other columns are ignored.
    """
    ranks_file = ranks_file or f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    # the vocabulary is read and divided once, by the driver
    held = documents.sparkSession.sparkContext.broadcast(merge_table(ranks_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = regex.compile(WORD_PATTERN).findall
        merger = None
        for batch in batches:
            for low in range(0, batch.num_rows, 2_000):
                part = batch.slice(low, 2_000)
                merger = merger or WordMerger(*held.value)
                words = [cut(t) if t else [] for t in part.column(1).to_pylist()]
                merger.learn(set(chain.from_iterable(words)))
                get = merger.known.__getitem__
                ids = [list(chain.from_iterable(map(get, w))) for w in words]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, ids array<int>")


def decode(ids: DataFrame, key: str = "doc_id", ranks_file: str | None = None) -> DataFrame:
    """(key, text) from (key, ids): the exact inverse of ``encode_corpus``, but for NULL texts, which come back empty."""
    ranks_file = ranks_file or f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {int(b): base64.b64decode(a) for a, b in (line.split() for line in Path(ranks_file).read_bytes().splitlines() if line)}
        for batch in batches:
            texts = [b"".join(names[i] for i in row).decode() if row is not None else None for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return ids.select(key, "ids").mapInArrow(run, f"`{key}` {ids.schema[key].dataType.simpleString()}, text string")
