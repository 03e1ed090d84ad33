"""Scores of all pairs of texts of a block, without meeting most of them one by one.

A common subsequence has no more of any letter than both texts have. Letter counts are written as bits, one for each further
occurrence, so the bound of a pair is a count of common bits, taken for whole tables of pairs at once. The few pairs that it
leaves are scored exactly, many side by side, by the bit-vector recurrence of `functions.text.indel_ratio`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from larder.functions import text as tx

#: Rows of a task that are compared together (whole groups), pairs in one table of bounds, and pairs scored together.
HELD_ROWS, TABLE_PAIRS, SCORED_PAIRS = 20_000, 400_000, 200_000
#: Entries of the table of letter positions of the texts scored together.
_MASKS = 4_000_000
_CLASSES = 32


class Texts:
    """Texts as code points, with lengths and letter bits of `words` 64-bit words (the commonest occurrences of all these texts;
    `rest` counts those that have no bit)."""

    def __init__(self, texts: Sequence[str], words: int):
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter, self.code = np.unique(code, return_inverse=True)
        self.letters = max(len(letter), 1)
        of = np.where((letter >= 97) & (letter <= 122), letter - 97, np.where(letter == 32, 26, 27 + letter % 5)).astype(np.int64)
        n = len(texts)
        row = np.repeat(np.arange(n), self.length)
        counts = np.bincount(row * _CLASSES + of[self.code], minlength=n * _CLASSES).reshape(n, _CLASSES)
        levels = [(int((counts[:, k] > j).sum()), k, j) for k in range(_CLASSES) for j in range(min(int(counts[:, k].max(initial=0)), 64 * words))]
        self.bits, given = np.zeros((words, n), np.uint64), np.zeros(_CLASSES, np.int64)
        for at, (_, k, j) in enumerate(sorted(levels, key=lambda x: (-x[0], x[2]))[: 64 * words]):
            self.bits[at // 64] |= (counts[:, k] > j).astype(np.uint64) << np.uint64(at % 64)
            given[k] += 1
        self.rest = np.maximum(counts - given, 0).sum(1)

    def bounds(self, x: slice, y: slice) -> np.ndarray:
        """Upper bounds of the ratios, from 0 to 1, of each text of x with each of y."""
        common = np.zeros((x.stop - x.start, y.stop - y.start), np.uint16)
        for w in self.bits:
            common += np.bitwise_count(w[x, None] & w[None, y])
        total = self.length[x, None] + self.length[None, y]
        out = 2.0 * common
        if self.rest.any():
            out += 2.0 * np.minimum(self.rest[x, None], self.rest[None, y])
        if not self.length.all():
            out += total == 0
            total = np.maximum(total, 1)
        out /= total
        return out

    def ratios(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """`indel_ratio` of text i with text j, for arrays of numbers."""
        total = self.length[i] + self.length[j]
        return np.where(total > 0, 200.0 * self.common(i, j) / np.maximum(total, 1), 100.0)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of text i with text j."""
        swap = self.length[i] > self.length[j]
        short, long_ = np.where(swap, j, i), np.where(swap, i, j)
        out = np.zeros(len(i), np.int64)
        size = -(-self.length[short] // 64)
        for words in np.unique(size[size > 0]).tolist():
            # Texts of one pattern side by side, so that a chunk has few patterns.
            at = np.flatnonzero(size == words)
            at = at[np.argsort(short[at], kind="stable")]
            chunk = max(1, min(65_536, _MASKS // (self.letters * words)))
            for k in range(0, len(at), chunk):
                p = at[k : k + chunk]
                out[p] = self._common(short[p], long_[p], words)
        return out

    def _common(self, short: np.ndarray, long_: np.ndarray, words: int) -> np.ndarray:
        patterns, row = np.unique(short, return_inverse=True)
        masks = np.zeros((words, len(patterns) * self.letters), np.uint64)
        start, length = self.start[patterns], self.length[patterns]
        for q in range(int(length.max())):
            has = np.flatnonzero(length > q)
            masks[q // 64, has * self.letters + self.code[start[has] + q]] |= np.uint64(1 << q % 64)
        order = np.argsort(-self.length[long_], kind="stable")
        start, length, row = self.start[long_[order]], self.length[long_[order]], row[order] * self.letters
        s = np.full((words, len(short)), ~np.uint64(0))
        for q in range(int(length[0])):
            n = int(np.searchsorted(-length, -q))  # texts of more than q letters
            cell = row[:n] + self.code[start[:n] + q]
            carry = None
            for w in range(words):
                v = s[w, :n]
                u = v & masks[w].take(cell)
                total = v + u
                if words > 1:
                    over = total < v
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    carry = over.astype(np.uint64)
                s[w, :n] = total | (v ^ u)
        out = np.empty(len(short), np.int64)
        out[order] = np.bitwise_count(~s).sum(0, dtype=np.int64)
        return out


def linked(names: Sequence[str], brands: Sequence[str], groups: Sequence[tuple[slice, slice]], weights: tuple[float, float, float], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of all pairs with a score of `threshold` at least: each row of x with each of y for the slices (x, y) of
    `groups`, each two rows once if both are the same. The score weighs the token-sorted ratio of names, the ratio of brands and the
    token-sorted ratio of both together."""
    wn, wb, wc = weights
    n, b = Texts([tx.token_sort(t) for t in names], 4), Texts(brands, 2)
    c = Texts([tx.token_sort(f"{t} {x}") for t, x in zip(names, brands)], 4)
    out: list[tuple[np.ndarray, ...]] = []
    open_: list[tuple[np.ndarray, ...]] = []

    def score() -> None:
        if not open_:
            return
        i, j, others = (np.concatenate(x) for x in zip(*open_))
        open_.clear()
        rn = n.ratios(i, j)
        k = np.flatnonzero(wn * rn / 100 + others >= threshold - 1e-9)
        i, j, rn = i[k], j[k], rn[k]
        s = (wn * rn + wb * b.ratios(i, j) + wc * c.ratios(i, j)) / 100
        k = np.flatnonzero(s >= threshold)
        out.append((i[k], j[k], s[k]))

    held = 0
    for x, y in groups:
        step = max(1, TABLE_PAIRS // max(1, y.stop - y.start))
        for x0 in range(x.start, x.stop, step):
            part = slice(x0, min(x0 + step, x.stop))
            to = slice(x0, y.stop) if x == y else y
            others = wb * b.bounds(part, to) + wc * c.bounds(part, to)
            i, j = np.nonzero(wn * n.bounds(part, to) + others >= threshold - 1e-9)
            found = (i + part.start, j + to.start, others[i, j])
            if x == y:
                found = tuple(v[j > i] for v in found)
            open_.append(found)
            held += len(found[0])
            if held >= SCORED_PAIRS:
                score()
                held = 0
    score()
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def link_rows(batches: Iterator[pa.RecordBatch], weights: tuple[float, float, float], threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b, score) from rows (key, lo, hi, slice, id, n, b) in order of all but the last two: groups of key, lo and hi."""
    held: pa.Table | None = None
    for r in batches:
        t = pa.Table.from_batches([r])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows >= HELD_ROWS:
            starts = _starts(held, ("key", "lo", "hi"))
            if len(starts) > 1:
                yield _links(held.slice(0, int(starts[-1])), weights, threshold)
                held = held.slice(int(starts[-1]))
    if held is not None and held.num_rows:
        yield _links(held, weights, threshold)


def _starts(t: pa.Table, columns: Sequence[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in columns:
        x = t[c].combine_chunks()
        new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _links(t: pa.Table, weights: tuple[float, float, float], threshold: float) -> pa.RecordBatch:
    t = t.combine_chunks()
    starts = np.append(_starts(t, ("key", "lo", "hi")), t.num_rows).tolist()
    lo, hi, part = (t[c].to_numpy() for c in ("lo", "hi", "slice"))
    groups = []
    for x, z in zip(starts, starts[1:]):
        y = x + int(np.searchsorted(part[x:z], hi[x])) if lo[x] < hi[x] else x
        groups.append((slice(x, y), slice(y, z)) if lo[x] < hi[x] else (slice(x, z), slice(x, z)))
    i, j, score = linked(t["n"].to_pylist(), t["b"].to_pylist(), groups, weights, threshold)
    ids = t["id"].combine_chunks()
    return pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(score)], names=["x", "y", "score"])
