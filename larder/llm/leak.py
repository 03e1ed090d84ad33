"""Evaluation texts leaking into training text, by winnowing.

Texts are folded to a stream of letters and digits, so case, spacing, punctuation, markup, look-alike letters and words
torn apart make no difference. Of each window of `window` consecutive k-gram hashes of a document the least is kept as
fingerprint; every k-gram of the items is a test fingerprint. A span of `window + k - 1` characters shared with an item
thus always gives a common fingerprint. Items that share enough fingerprints with a document are extended: all common
k-grams become maximal equal stretches, and the best chain of stretches in order, with a cost for what lies between them,
is the running passage. The chain's item words are counted against the share asked for.

The test items are the stated query set. They are handed to the tasks in blocks of at most `block_chars` characters, so
what is sent has a fixed bound for test sets of any size, and the corpus itself is never shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.text import fold, letters, mend

K, WINDOW = 9, 6
_PRIME = np.uint64(0x100000001B3)
_WORD = re.compile(r"\w+")
_BREAK = re.compile(r"[^\W_]+")
_OPENING = re.compile(r"(?:^|[.!?:;\n])[\s\"'“”„«»‘’()\[\]¿¡*\-]*$")


def codes(stream: str) -> np.ndarray:
    """The characters of a stream as numbers."""
    return np.frombuffer(stream.encode("utf-32-le", "replace"), np.uint32)


def gram_hashes(stream: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of the k-gram at each position of an array of characters."""
    n = len(stream) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ stream[j : j + n].astype(np.uint64)) * _PRIME
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x9E3779B97F4A7C15)


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of each window (the rightmost of equals), each once; of a short text its least hash."""
    if len(h) == 0:
        return np.empty(0, np.int64)
    if len(h) <= window:
        return np.array([int(h.argmin())])
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(1))


class Items:
    """Folded test items with the positions of their k-grams. `fixed` are the words that tell items built alike apart: numbers, and
    names (written with a capital that some item has within a sentence)."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.streams, self.word_ends, self.n_words, self.fixed = [], [], [], [], []
        grams: dict[int, list[tuple[int, int]]] = defaultdict(list)
        names = {letters(m.group()) for _, text in rows for m in _WORD.finditer(text) if m.group()[0].isupper() and not _OPENING.search(text[max(0, m.start() - 12) : m.start()])}
        for item_id, text in rows:
            pairs = [(w, x) for w, x in ((letters(x), x) for x in _WORD.findall(text)) if w]
            words = [w for w, _ in pairs]
            if not words:
                continue
            stream = "".join(words)
            at = len(self.ids)
            self.ids.append(item_id)
            self.streams.append(stream)
            self.word_ends.append(np.cumsum([len(w) for w in words]))
            self.n_words.append(len(words))
            self.fixed.append(np.array([any(c.isdigit() for c in w) or (x[0].isupper() and w in names) for w, x in pairs]))
            for p, h in enumerate(gram_hashes(codes(stream)).tolist()):
                grams[h].append((at, p))
        self.grams = dict(grams)
        self.hashes = np.sort(np.fromiter(self.grams, np.uint64, len(self.grams)))


def single_word(ends: np.ndarray, lo: int, hi: int) -> bool:
    """Whether the letters from `lo` to `hi` are no more than one word; equal letters around may have moved them from its borders."""
    return int(np.searchsorted(ends, hi, "right") - np.searchsorted(ends, lo, "right")) <= 1


def best_passage(
    item: str, text: str, seeds: list[tuple[int, int]], ends: np.ndarray, fixed: np.ndarray, text_ends: np.ndarray,
    k: int = K, gap_cost: float = 6.0, most_cost: float = 60.0, word_cost: float = 5.0, max_gap: int = 60,
) -> tuple[int, int]:
    """Item range (start, end) of the best chain of equal stretches; `seeds` are (item position, text position) of equal k-grams.

    A single word put in or replaced costs `word_cost`, less than the shortest stretch brings; a sentence built alike with other
    names and numbers (words `fixed` in the item) and longer gaps cost by the letter. `ends` and `text_ends` are the ends of words.
    """
    stretches = []
    reached: dict[int, int] = {}
    for p, q in sorted(seeds, key=lambda s: (s[1] - s[0], s[0])):
        d = q - p
        if reached.get(d, -1) > p:
            continue
        a, b = p, p + k
        while a > 0 and q - (p - a) > 0 and item[a - 1] == text[a - 1 + d]:
            a -= 1
        while b < len(item) and b + d < len(text) and item[b] == text[b + d]:
            b += 1
        reached[d] = b
        stretches.append((a, b, d))
    stretches.sort()
    best, start, top = [], [], (0.0, 0, 0)
    for i, (a, b, d) in enumerate(stretches):
        score, first = float(b - a), a
        for j in range(i - 1, -1, -1):
            a2, b2, d2 = stretches[j]
            if a2 >= a or a - b2 > max_gap:
                continue
            over = max(0, b2 - a, (b2 + d2) - (a + d))
            if over >= b - a or a + d <= a2 + d2:
                continue
            gap = max(a + over - b2, a + over + d - b2 - d2)
            if gap > max_gap:
                continue
            lo, hi = b2, max(b2, a + over)
            t_lo, t_hi = b2 + d2, max(b2 + d2, a + over + d)
            touched = fixed[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, hi - 1, "right") + 1] if hi > lo else fixed[:0]
            light = not touched.any() and single_word(ends, lo, hi) and single_word(text_ends, t_lo, t_hi) and not any(c.isdigit() for c in text[t_lo:t_hi])
            s = best[j] + (b - a - over) - min(gap_cost * gap, most_cost, word_cost if light else most_cost)
            if s > score:
                score, first = s, start[j]
        best.append(score)
        start.append(first)
        if score > top[0]:
            top = (score, first, b)
    return top[1], top[2]


def leaks_of(text: str, items: Items, share: float, min_seeds: int = 3) -> list[tuple[int, int, int]]:
    """(item id, words of the longest running passage, words of the item) for the items of which `text` holds a `share`."""
    stream = letters(text)
    if len(stream) < K:
        return []
    h = gram_hashes(codes(stream))
    prints = winnow(h)
    at = np.searchsorted(items.hashes, h[prints])
    hit = prints[items.hashes[np.minimum(at, len(items.hashes) - 1)] == h[prints]]
    if len(hit) < min_seeds:
        return []
    count: dict[int, list[int]] = defaultdict(list)
    for q in hit.tolist():
        for i in {i for i, _ in items.grams[int(h[q])]}:
            count[i].append(q)
    wanted = {}
    for i, qs in count.items():
        need = len(items.streams[i]) * share
        # Least number of fingerprints of a passage half of which lies in stretches long enough to have any.
        if len(qs) >= max(min_seeds, int(need * 0.25 / WINDOW)):
            wanted[i] = qs
    if not wanted:
        return []
    known = np.flatnonzero(items.hashes[np.minimum(np.searchsorted(items.hashes, h), len(items.hashes) - 1)] == h)
    seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for q in known.tolist():
        for i, p in items.grams[int(h[q])]:
            if i in wanted:
                seeds[i].append((p, q))
    out = []
    text_ends = np.cumsum([len(w) for w in _BREAK.findall(fold(mend(text)))])
    for i, s in seeds.items():
        ends = items.word_ends[i]
        a, b = best_passage(items.streams[i], stream, s, ends, items.fixed[i], text_ends)
        starts = np.concatenate(([0], ends[:-1]))
        # A word counts if most of it lies in the passage.
        inside = np.minimum(ends, b) - np.maximum(starts, a)
        n = int((inside * 2 > ends - starts).sum())
        if n >= share * items.n_words[i]:
            out.append((items.ids[i], n, items.n_words[i]))
    return out


def find_leaks(docs: DataFrame, tests: DataFrame, share: float = 1 / 3, block_chars: int = 400_000) -> DataFrame:
    """One row (doc_id, item_id, words_found, words_item) per document and item of which it holds a running passage of at
    least `share` of the item's words. Null or empty texts and items without a letter or digit give no rows; copies of a
    document each get their rows; repeated items with one id give one row."""
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in tests.filter(F.col("text").isNotNull()).select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        if size + len(r.text) > block_chars and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((r.item_id, r.text))
        size += len(r.text)
    out = None
    for rows in blocks:
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value)
            for batch in batches:
                found = [(d, *x) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) if t for x in leaks_of(t, items, share)] if items.ids else []
                cols = list(zip(*found)) if found else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "words_found", "words_item"])

        part = docs.select("doc_id", "text").mapInArrow(search, "doc_id long, item_id long, words_found long, words_item long")
        out = part if out is None else out.union(part)
    return out.distinct()


def found(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The leaked pairs alone."""
    return find_leaks(docs, tests).select("doc_id", "item_id").distinct()
