"""Template residue, filler, error pages and scripts-required notices in documents.

A naive Bayes model over passages is learnt from positive and unlabelled data.  Passages with a trusted placeholder, failed
value, error or notice are the positives; all others are unlabelled, start as no residue and are re-estimated by
expectation-maximisation.  The last model alone decides: a passage is as bad as its worst stretch of words, and a record is
residue if one of its passages is.  Trusted phrases only label passages for the fit; they neither find nor excuse a document.

Passages are counted once per distinct wording before the model is fitted; its weights are held in a fixed number
of hashed cells, so what the driver gathers doesn't grow with the corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed cells of the model; the driver holds two numbers for each.
CELL_BITS = 18
CELLS = 1 << CELL_BITS
ROUNDS = 4
#: Log odds from which a passage is residue: more likely than not.
LEAST_ODDS = 0.0
#: Words of a passage that are scored together; a passage is as bad as its worst stretch.
STRETCH = 8
#: Evidence, in counts, that a cell must outweigh to move away from the share of residue at large.
SHRINK = 30.0

#: Distinct tokens that a task remembers between batches; when more have come up it starts anew.
KNOWN_TOKENS = 1_000_000
#: Characters that are read into arrays at once; a longer text is one piece.
PIECE = 2_000_000

_NAME = r"[A-Za-z][\w .\-]{0,40}?"
# Unfilled placeholders by the marks around a field's name, and the form of unfilled days; each with a text that every match holds.
PLACEHOLDERS = (
    ("{", r"\{\{\s*" + _NAME + r"\s*\}\}"), ("$", r"\$\{\s*" + _NAME + r"\s*\}"), ("<", r"<<\s*" + _NAME + r"\s*>>"), ("<", r"<%=?\s*" + _NAME + r"\s*%>"), ("{", r"\{%\s*" + _NAME + r"\s*%\}"), ("[", r"\[\[\s*" + _NAME + r"\s*\]\]"),
    ("@", r"@@\s*" + _NAME + r"\s*@@"), ("«", r"«\s*" + _NAME + r"\s*»"), ("_", r"__[A-Za-z][A-Za-z0-9_. ]*?__"), ("%", r"(?<![\w%])%[A-Za-z][A-Za-z_.]{1,30}%(?!\w)"), ("#", r"(?<![\w#])#[A-Za-z][A-Za-z_.]{1,30}#(?!\w)"),
    ("$", r"(?<![\w$])\$[A-Za-z][A-Za-z_]{1,30}\$(?!\w)"), ("[", r"\[\s*(?:INSERT|Insert|insert|ENTER|Enter|enter)\b[^\]]{0,40}\]"), ("[", r"\[(?:[A-Za-z]+_[A-Za-z_]+|[Yy]our [a-z ]{2,30})\]"),
    ("(", r"\((?:enter|insert|ENTER|INSERT|Enter|Insert) [A-Za-z_. ]{2,30}\)"), ("<", r"<(?:enter|insert|ENTER|INSERT|Enter|Insert) [A-Za-z_. ]{2,30}>"), ("<", r"<[A-Za-z_. ]{2,30} here>"), ("YYYY", r"\bDD/MM/YYYY\b"), ("XXX", r"\bX{3,}(?: X{3,})+\b"),
)
# Failed values that stand where content should, and lines of program traces; each with a text that every match holds.
FAILED = (
    ("#", r"(?<!\w)#(?:REF|DIV/0|NAME|NUM|NULL|VALUE|N/A)[!?]"), ("[", r"\[object Object\]"), ("[", r"\[[a-z]+(?: [a-z]+)* not found\]"), ("Invalid", r"\bInvalid Date\b"), ("NaN", r"\bNaN\b"), ("undefined", r":\s*undefined\b"), ("null", r":\s*null\b"), ("None", r":\s*None\b"), ("undefined", r"\bundefined undefined\b"), ("null", r"\bnull null\b"),
    ("Exception", r"\b(?:[a-z]+\.)+[A-Z]\w*Exception\b"), ("Error", r"\b(?:[a-z]+\.)+[A-Z]\w*Error\b"), ("Exception", r"\b\w+Exception: "), ("Error", r"\b\w+Error: "), ("(", r"\bat [a-z]\w*(?:\.\w+)+\(\w+\.\w+:\d+\)"), ("File", r"\bFile \"[^\"]+\", line \d+"),
)
# Phrases that templates, servers and programs everywhere show, in small letters.
PHRASES = (
    "lorem ipsum", "click here to enter text", "choose an item", "text goes here", "your text here", "type your summary", "type your name", "add a short description", "content coming soon", "placeholder text", "placeholder paragraph", "placeholder copy", "replace this text", "intentionally left blank", "sample text", "asdf", "qwerty",
    "400 bad request", "401 unauthorized", "403 forbidden", "404 not found", "410 gone", "internal server error", "502 bad gateway", "503 service unavailable", "service temporarily unavailable", "gateway timeout", "gateway time-out",
    "page not found", "http error", "page introuvable", "seite nicht gefunden", "could not be found on this server", "something went wrong", "unhandled exception", "an unexpected error", "traceback (most recent call last)", "undefined index", "undefined variable", "division by zero in",
    "sql error", "query timed out", "erreur interne", "interner fehler", "mae gwall", "down for maintenance", "no data to display", "try again later", "check back later", "contact the administrator", "the application will now close",
    "access denied", "you do not have permission", "session has expired", "too many requests", "not a robot", "log in to continue", "sign in again", "your address has been blocked",
    "enable javascript", "turn on javascript", "javascript is required", "requires javascript", "javascript must be enabled", "activer javascript", "aktivieren sie javascript", "angen javascript", "enable cookies", "cookies are required", "browser is not supported", "scripts turned off",
)
_AGAIN = re.compile(r"\b(\w{3,}(?: \w{3,})?)(?: \1){2,}\b")
_QUOTED = re.compile(r"\n\s*(?:[>|]\s*)+")
_TOKEN = re.compile(r"\w+|[^\w ]")
# ends of sentences and of texts: signs that count as blanks in a text and so are in none that was read
_NEXT, _OTHER = "\n", "\x1e"


def sentences(text: str) -> str:
    """A text with one sentence a line; line breaks, and quote marks at line starts, are blanks."""
    if "\n>" in text or "\n|" in text or "\n " in text:
        text = _QUOTED.sub(" ", text)
    flat = " ".join(text.split())
    for end in ".!?…":
        flat = flat.replace(f"{end} ", f"{end}\n")
    return flat


def passages(text: str | None) -> list[str]:
    """Sentences of a text; none for NULL or blank texts."""
    return [p for p in sentences(text).split("\n") if p] if text else []


class Trust:
    """The test for a trusted passage: one of the patterns, one of the phrases as whole words, or a word or pair thrice in a row."""

    def __init__(self, patterns: Sequence[tuple[str, str]] = (*PLACEHOLDERS, *FAILED), phrases: Sequence[str] = PHRASES) -> None:
        self.patterns = re.compile("|".join(f"(?:{p})" for _, p in patterns) or "(?!)")
        self.phrases = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(p) for p in phrases) + r")(?!\w)" if phrases else "(?!)")
        # what a passage must hold to be worth the test: a token with a pattern's text inside, or the first words of a phrase (two, if only a blank parts them)
        self.inside = re.compile("|".join(sorted(re.escape(t) for t, _ in patterns)) or "(?!)")
        self.words = {w for p in phrases for w in re.findall(r"\w+", p)}
        starts = [re.match(r"\w+(?: \w+)?", p)[0].split() for p in phrases]
        self.single = {w[0] for w in starts if len(w) == 1}
        self.place = {w: k for k, w in enumerate(sorted({w for s in starts if len(s) == 2 for w in s}), 1)}
        self.pairs = np.array(sorted(self.place[a] << 16 | self.place[b] for a, b in (s for s in starts if len(s) == 2)), dtype=np.int64)

    def __call__(self, passage: str) -> bool:
        return bool(self.patterns.search(passage) or self.phrases.search(passage.lower()) or _AGAIN.search(passage))

    def calls_for(self, token: str) -> bool:
        """Whether a passage with this token may pass the test by a pattern, or by a phrase that this word alone begins."""
        return token.lower() in self.single or bool(self.inside.search(token))


class Lexer(dict):
    """Texts to arrays of hashed tokens; remembers the distinct tokens it has met."""

    def __init__(self, trust: Trust) -> None:
        super().__init__()
        self.trust = trust
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.first, self.rest, self.tested, self.place = [0, 0], [0, 0], [False, False], [0, 0]
        self[_NEXT], self[_OTHER] = 0, 1

    def __missing__(self, token: str) -> int:
        if not token.isalpha() and any(map(str.isdigit, token)):
            plain = named = "9" * min(len(token), 4)
        elif "_" in token:
            plain = named = "__a__" if token[0] == "_" else "a_a"
        else:
            plain = token.lower()
            named = "Nn" if len(token) > 5 and token[0].isupper() and token[1:].islower() and plain not in self.trust.words else plain
        # the lowest bit tells words from figures, signs and names
        code = lambda t: xxhash.xxh32_intdigest(t) & 0xFFFFFFFE | (t[0].isalpha() and t != "Nn")
        self[token] = len(self.first)
        self.first.append(code(plain))
        self.rest.append(code(named))
        self.tested.append(self.trust.calls_for(token))
        self.place.append(self.trust.place.get(token.lower(), 0))
        return self[token]

    def read(self, texts: Sequence[str | None], test: bool = False) -> Passages:
        """The passages of all texts; with ``test``, which of them are trusted."""
        if len(self) > KNOWN_TOKENS:
            self.restart()
        flat = [sentences(t) if t else "" for t in texts]
        tokens = _TOKEN.findall(_OTHER.join(flat))
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        breaks, others = np.cumsum(at <= 1), np.cumsum(at == 1)
        kept = np.flatnonzero(at > 1)
        begins = np.flatnonzero(np.diff(breaks[kept], prepend=-1))
        start, at = kept[begins], at[kept]
        codes = np.array(self.rest, dtype=np.uint32)[at]
        codes[begins] = np.array(self.first, dtype=np.uint32)[at[begins]]
        row, trusted = others[start], np.zeros(len(begins), dtype=bool)
        if test and len(begins):
            sentence = breaks[start] - np.concatenate([[0], breaks[np.diff(others, prepend=0) > 0]])[row]
            word = np.array(self.place, dtype=np.int64)[at]
            before, has = back(word, begins, 1)
            starts = has & (word > 0) & (before > 0)
            starts[starts] = np.isin(before[starts] << 16 | word[starts], self.trust.pairs)
            calls = np.logical_or.reduceat(np.array(self.tested)[at] | again(at * 2 + 1, begins) | starts, begins)
            for k in np.flatnonzero(calls):
                trusted[k] = self.trust(flat[row[k]].split(_NEXT)[sentence[k]])
        return Passages(codes, begins, row, trusted)


@dataclass(frozen=True)
class Passages:
    """``codes``: hashed tokens of all passages one after another; ``begins``: where each starts; ``row``: its text; ``trusted``."""

    codes: np.ndarray
    begins: np.ndarray
    row: np.ndarray
    trusted: np.ndarray


def back(codes: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token the one ``k`` places before it, and whether that belongs to the same passage."""
    place = np.arange(len(codes)) - np.repeat(begins, np.diff(begins, append=len(codes)))
    return np.concatenate([np.zeros(k, dtype=codes.dtype), codes[:-k]])[: len(codes)], place >= k


def again(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a token is a word that repeats the one before it, or ends a pair that repeats the pair before it."""
    (one, has1), (two, has2), (three, has3) = (back(codes, begins, k) for k in (1, 2, 3))
    return (codes & 1 == 1) & ((has1 & (codes == one)) | (has2 & (codes == two) & has3 & (one == three)))


def cells_of(codes: np.ndarray, begins: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The model's cells for each token as (cell, whether it counts, words it reaches back): the token itself, with its neighbour, with the one beyond, a repeat."""
    (one, has1), (two, has2) = back(codes, begins, 1), back(codes, begins, 2)
    mixed = lambda a, b, salt: ((a * np.uint32(2654435761) ^ b) * np.uint32(salt) >> np.uint32(32 - CELL_BITS)).astype(np.int64)
    every = np.ones(len(codes), dtype=bool)
    return [(mixed(codes, codes, 2246822519), every, 0), (mixed(one, codes, 3266489917), has1, 1), (mixed(two, codes, 668265263), has2, 2), (np.full(len(codes), CELLS), again(codes, begins), 0)]


def pieces(texts: Sequence[str | None], most: int = PIECE) -> Iterator[slice]:
    """Runs of texts with about ``most`` characters in all, so that long texts don't swell the arrays of a whole batch."""
    low = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield slice(low, k + 1)
            low, size = k + 1, 0
    if low < len(texts):
        yield slice(low, len(texts))


class Model:
    """Weights of the cells (log ratios) and the prior log odds of a passage."""

    def __init__(self, positive: np.ndarray, negative: np.ndarray, passages: tuple[float, float]) -> None:
        share = (positive.sum() + 1) / (positive.sum() + negative.sum() + 2)
        part = (positive + SHRINK * share) / (positive + negative + SHRINK)
        self.weights = (np.log(part / (1 - part)) - math.log(share / (1 - share))).astype(np.float32)
        self.prior = math.log((passages[0] + 1) / (passages[1] + 1))

    def whole(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """For each passage the log odds of all its words together."""
        total = np.full(len(begins), self.prior)
        if len(begins):
            for cell, counts, _ in cells_of(codes, begins):
                total += np.add.reduceat(np.where(counts, self.weights[cell], 0.0), begins)
        return total

    def worst(self, codes: np.ndarray, begins: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
        """For each passage the log odds of its stretch that is most like residue; a shorter passage is one stretch."""
        if not len(begins):
            return np.empty(0)
        sizes = np.diff(begins, append=len(codes))
        ends = np.repeat(begins + sizes, sizes)
        low = np.arange(len(codes))
        total = np.full(len(codes), self.prior)
        for cell, counts, reach in cells_of(codes, begins):
            sums = np.concatenate([[0.0], np.cumsum(np.where(counts, self.weights[cell], 0.0))])
            high = np.minimum(low + stretch, ends)
            # what reaches back before the stretch isn't part of it
            total += sums[high] - sums[np.minimum(low + reach, high)]
        # a stretch is whole unless the passage is shorter
        whole = (low + stretch <= ends) | (low == np.repeat(begins, sizes))
        return np.maximum.reduceat(np.where(whole, total, -np.inf), begins)


def distinct_wordings(rows: DataFrame, trust: Trust) -> DataFrame:
    """(codes, sure, n): each distinct wording of the corpus and its number, counted before and after the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer = Lexer(trust)
        for batch in batches:
            texts, seen = batch.column(0).to_pylist(), {}
            for piece in pieces(texts):
                found = lexer.read(texts[piece], test=True)
                raw, ends = found.codes.tobytes(), [*found.begins[1:].tolist(), len(found.codes)]
                for a, b, sure in zip(found.begins.tolist(), ends, found.trusted.tolist(), strict=False):
                    entry = seen.setdefault(raw[4 * a : 4 * b], [False, 0])
                    entry[0] |= sure
                    entry[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([v[0] for v in seen.values()], pa.bool_()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["codes", "sure", "n"])

    return rows.mapInArrow(run, "codes binary, sure boolean, n bigint").groupBy("codes").agg(F.bool_or("sure").alias("sure"), F.sum("n").alias("n"))


def fit(wordings: DataFrame, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation from trusted and unlabelled wordings: trusted ones stay positive, the others start negative."""
    model = None
    for _ in range(rounds):
        held = wordings.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            pos, neg, passages = np.zeros(CELLS + 1), np.zeros(CELLS + 1), np.zeros(2)
            for batch in batches:
                column = batch.column(0)
                ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
                codes, sizes = np.frombuffer(column.buffers()[2], dtype=np.uint32, count=(ends[-1] - ends[0]) // 4, offset=ends[0]), np.diff(ends) // 4
                begins, share = np.cumsum(sizes) - sizes, batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                if held.value is not None:
                    share = np.maximum(share, 1 / (1 + np.exp(-np.clip(held.value.whole(codes, begins), -500, 500))))
                n = batch.column(2).to_numpy().astype(float)
                passages += (n * share).sum(), (n * (1 - share)).sum()
                up, down = np.repeat(n * share, sizes), np.repeat(n * (1 - share), sizes)
                for cell, counts, _ in cells_of(codes, begins):
                    pos += np.bincount(cell[counts], up[counts], CELLS + 1)
                    neg += np.bincount(cell[counts], down[counts], CELLS + 1)
            used = np.flatnonzero(pos + neg)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()), pa.array([passages[0], *pos[used]]), pa.array([passages[1], *neg[used]])], names=["cell", "pos", "neg"])

        found = wordings.select("codes", "sure", "n").mapInArrow(expect, "cell int, pos double, neg double").groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
        cell, counts = found.column("cell").to_numpy(), np.zeros((2, CELLS + 2))
        counts[:, cell + 1] = found.column("pos").to_numpy(), found.column("neg").to_numpy()
        model = Model(counts[0, 1:], counts[1, 1:], (counts[0, 0], counts[1, 0]))
        held.unpersist()
    return model


def residue_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", least_odds: float = LEAST_ODDS, trust: Trust | None = None) -> DataFrame:
    """(key, passages, odds): documents with residue, the number of such passages and the highest log odds among them.

    A passage is residue if the fitted model gives its worst stretch at least ``least_odds``; nothing else is asked.  ``trust``
    labels the passages that the fit starts from.  NULL, empty and blank texts are never residue; repeated documents count
    each; texts of any length are read whole; an empty table, or one without any trusted passage, gives none.
    """
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    trust = trust or Trust()
    wordings = distinct_wordings(rows.select("text"), trust).persist(StorageLevel.MEMORY_AND_DISK)
    none = not wordings.where("sure").limit(1).count()
    held = documents.sparkSession.sparkContext.broadcast(None if none else fit(wordings))
    wordings.unpersist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lexer = held.value, Lexer(trust)
        for batch in batches:
            texts = batch.column(1).to_pylist() if model else []
            for piece in pieces(texts):
                found = lexer.read(texts[piece])
                odds = model.worst(found.codes, found.begins)
                bad = odds >= least_odds
                at, first, counts = np.unique(found.row[bad], return_index=True, return_counts=True)
                if len(at):
                    worst = np.maximum.reduceat(odds[bad], first)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + piece.start)), pa.array(counts, pa.int32()), pa.array(worst, pa.float64())], names=[key, "passages", "odds"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, passages int, odds double")
