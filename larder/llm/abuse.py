"""Abusive, hateful or sexual content, by a support vector machine on a subsequence string kernel.

The kernel of two sentences is the weighted count of common character subsequences of three and four letters, gaps allowed
up to a span bound and each gap discounted, so words with inserted, doubled or masked characters stay close to the plain
word. The machine is trained on Nyström features of at most `landmarks` sentences. As a subsequence kernel is the inner
product of explicit subsequence counts (hashed to `DIM` slots), the trained machine folds into one weight per subsequence;
scoring a sentence is then the sum of the weights of its subsequences over its norm, exactly the machine's decision value.
Running sums give the value of every window of a sentence as well, so an insult inside a long sentence counts in full.

Labels start from the built-in sentences. Reviewers judge whole documents and some judgements are wrong, so what reviewed
documents say about their sentences is learned in rounds (`fit`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.llm.abuse_sentences import ABUSIVE, HARMLESS
from larder.llm.text import fold, mend
from larder.session import cut

DIM = 1 << 16
#: Weight of a built-in sentence, and of a document without verdict, against a reviewed document.
SEED_WEIGHT, UNJUDGED_WEIGHT = 2.0, 0.3
#: Cost of a sentence on the wrong side, in the first round and later.
FIRST_C, C = 0.3, 4.0
#: Value from which the machine may doubt a "fine", and from which a sentence without verdict is clearly abusive.
SURE, CLEAR = 0.8, 0.4
LAMBDA = 0.6
#: Decision value from which a document counts as unwanted.
THRESHOLD = -0.3
#: Lengths of the windows that are scored beside whole sentences, so that an insult run into harmless text is not diluted.
SPANS = (64, 96)
#: Offsets of the characters of a subsequence from its first one: three letters in a span of five, four in a span of five.
SHAPES = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4))
_PAD = 5
_WEIGHTS = tuple(LAMBDA ** (s[-1] - len(s)) for s in SHAPES)
_NORM = float(sum(w * w for w in _WEIGHTS))
_SPLIT = re.compile(r"(?<=[.!?…。！？])\s*(?=[^\s.!?…])|[\n\r]+|\s+lol\b")
_RUN = re.compile(r"(.)\1{2,}")
_SPACE = re.compile(r"[^\w@$*.!?']+|_+")
_DIGITS = re.compile(r"[0-9]+")
_LEET = str.maketrans({"@": "a", "$": "s", "!": "i", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"})
_INSIDE = re.compile(r"(?<=[a-z])[@$!01345]+(?=[a-z@$])|(?<![^\s])[@$]+[0-9@$!]*(?=[a-z])")
_SPELLED = re.compile(r"\b(?:[a-z@$][.\-_*]){2,}[a-z]\b|(?<!\S)(?:[a-z@$] ){3,}[a-z](?!\S)")
_HIDDEN = re.compile("[\u200b-\u200f\u00ad\u2060-\u2064\ufeff]")
_WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\u3040-\u30ff]")


def normal(sentence: str) -> str:
    """Folded sentence: signs and digits used as letters as those letters, spelled-out words joined, runs of a character cut,
    numbers as 0. Letters of every script stay."""
    s = fold(_HIDDEN.sub("", sentence))
    s = _RUN.sub(r"\1", s)
    s = _INSIDE.sub(lambda m: m.group().translate(_LEET), s)
    s = _SPELLED.sub(lambda m: re.sub(r"[.\-_* ]", "", m.group()), s)
    s = _DIGITS.sub("0", s)
    return _SPACE.sub(" ", s).strip(" .!?'")


def sentences(text: str) -> list[str]:
    """Normalised sentences of a whole text, of any length; those without two letters of a script with words of one sign, or four
    characters otherwise, say nothing."""
    out = []
    for raw in _SPLIT.split(mend(text)):
        s = normal(raw)
        if len(s) >= 4 or len(_WIDE.findall(s)) >= 2:
            out.append(s)
    return out


def windows(unit: str, span: int = SPANS[0]) -> list[str]:
    """A sentence as it is up to `span` characters, a longer one as overlapping windows that begin at words."""
    if len(unit) <= span:
        return [unit]
    out, at = [], 0
    while True:
        out.append(unit[at : at + span].strip())
        if at + span >= len(unit):
            return out
        nxt = unit.find(" ", at + span // 3)
        at = nxt + 1 if 0 <= nxt < at + span else at + span // 3


def _positions(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All units as one array of characters with padding, and the start and length of each."""
    raw = [f" {u} " for u in units]
    lengths = np.fromiter((len(r) for r in raw), np.int64, len(raw))
    starts = np.concatenate(([0], np.cumsum(lengths + _PAD)[:-1])) if len(raw) else np.empty(0, np.int64)
    return np.frombuffer((("\0" * _PAD).join(raw) + "\0" * _PAD).encode("utf-32-le", "replace"), np.uint32), starts, lengths


def _slots(a: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash slot of the subsequence of this shape at each position, and whether it lies inside its unit."""
    n = len(a) - _PAD
    h = a[:n] + np.uint32(len(shape)) * np.uint32(977)
    inside = a[:n] != 0
    for o in shape:
        h = (h * np.uint32(2654435761)) ^ (a[o : o + n] * np.uint32(40503))
        inside &= a[o : o + n] != 0
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    return (h >> np.uint32(16)).astype(np.int64), inside


def norms(lengths: np.ndarray) -> np.ndarray:
    """Norm of the subsequence counts of units of these lengths (all subsequences taken as different, which their counts nearly
    are)."""
    return np.sqrt(np.asarray(lengths) * _NORM)


def scores(units: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Decision value of each unit: the highest of itself and its windows of SPANS characters that begin at words."""
    if not units:
        return np.empty(0)
    a, starts, lengths = _positions(units)
    each = np.zeros(len(a) - _PAD, np.float32)
    for shape, w in zip(SHAPES, _WEIGHTS):
        slot, inside = _slots(a, shape)
        each += np.where(inside, weights[slot] * np.float32(w), np.float32(0))
    total = np.concatenate(([0.0], np.cumsum(each, dtype=np.float64)))
    out = (total[starts + lengths] - total[starts]) / norms(lengths)
    long = np.flatnonzero(lengths > SPANS[0])
    if len(long):
        owner = np.repeat(long, lengths[long])
        at = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[long].tolist(), lengths[long].tolist())])
        begins = (a[at] == 32) | (at % 16 == 0) & (a[at] > 0x2E80)
        at, owner = at[begins], owner[begins]
        ends = starts[owner] + lengths[owner]
        for span in SPANS:
            fits = at + span < ends
            np.maximum.at(out, owner[fits], (total[at[fits] + span] - total[at[fits]]) / norms(span))
    return out + bias


def _sparse(units: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and normalised counts of each unit."""
    out = []
    for u in units:
        a, _, lengths = _positions([u])
        slots, values = [], []
        for shape, w in zip(SHAPES, _WEIGHTS):
            s, inside = _slots(a, shape)
            slots.append(s[inside])
            values.append(np.full(int(inside.sum()), w, np.float32))
        s, v = np.concatenate(slots), np.concatenate(values)
        u_s, inv = np.unique(s, return_inverse=True)
        out.append((u_s, (np.bincount(inv, v) / norms(lengths)[0]).astype(np.float32)))
    return out


def train_svm(units: list[str], labels: np.ndarray, times: np.ndarray | None = None, landmarks: int = 1200, c: float | None = None, seed: int = 7) -> tuple[np.ndarray, float]:
    """Squared-hinge machine on Nyström features; (weight per slot, bias). `times` are the weights of the sentences; landmarks
    are drawn by them, half of each class."""
    rng = np.random.default_rng(seed)
    times = np.ones(len(units)) if times is None else times
    draw = lambda rows, n: rng.choice(rows, min(n, len(rows)), replace=False, p=times[rows] / times[rows].sum())
    pos, neg = np.flatnonzero(labels > 0), np.flatnonzero(labels < 0)
    chosen = np.concatenate([draw(pos, landmarks // 2), draw(neg, landmarks - min(landmarks // 2, len(pos)))])
    phi = _sparse(units)
    k = np.zeros((len(units), len(chosen)), np.float32)
    for lo in range(0, len(chosen), 200):  # a block of landmarks at a time keeps the dense table small
        part = chosen[lo : lo + 200]
        marks = np.zeros((DIM, len(part)), np.float32)
        for j, i in enumerate(part):
            marks[phi[i][0], j] = phi[i][1]
        for r, (s, v) in enumerate(phi):
            k[r, lo : lo + len(part)] = v @ marks[s]
    value, vector = np.linalg.eigh(k[chosen].astype(np.float64) + 1e-4 * np.eye(len(chosen)))
    root = vector / np.sqrt(np.maximum(value, 1e-6))
    z = np.hstack([k @ root.astype(np.float32), np.ones((len(units), 1), np.float32)])
    cost = (times * (C if c is None else c)).astype(np.float32)[:, None]
    y = labels.astype(np.float32)
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(20):  # Newton steps on the active rows
        on = 1 - labels * (z @ w) > 0
        za = z[on] * cost[on]
        step = np.linalg.solve(ridge + za.T @ z[on], za.T @ y[on])
        if np.abs(step - w).max() < 1e-4:
            break
        w = step
    dual = root @ w[:-1]
    folded = np.zeros(DIM, np.float32)
    for j, i in enumerate(chosen):
        folded[phi[i][0]] += phi[i][1] * np.float32(dual[j])
    return folded, float(w[-1])


def fit(rows: list[tuple[float, list[str]]], max_sentences: int = 14_000, rounds: int = 4, seed: int = 11) -> tuple[np.ndarray, float]:
    """Machine from documents as (share of "unwanted" verdicts, below zero without a verdict; distinct normalised sentences).

    A verdict speaks of a document, not of a sentence. At first every window of a document called unwanted counts as positive and
    every one of a document called fine as negative, with little trust in any: what unwanted documents share with the others
    cancels out, and what only they have remains. Then the worst window by the machine of each unwanted document is
    positive, the windows of fine documents are negative unless far on the positive side (likely a wrong verdict), and so are the
    other windows of unwanted documents and those without verdict that lie on the negative side. From the second such round on
    the worst windows of documents without verdict are positive, too, if they are clearly so. At most `max_sentences`
    windows take part in a round, the negatives nearest to the boundary first."""
    rng = np.random.default_rng(seed)
    seeds = [normal(s) for s in ABUSIVE + HARMLESS]
    seed_labels = np.array([1.0] * len(ABUSIVE) + [-1.0] * len(HARMLESS))
    seed_times = np.full(len(seeds), SEED_WEIGHT)
    weights, bias = train_svm(seeds, seed_labels, seed_times)
    index: dict[str, int] = {}
    held = [(share, [index.setdefault(u, len(index)) for u in dict.fromkeys(w for unit in units for w in windows(unit))]) for share, units in rows]
    if not index:
        return weights, bias
    texts = list(index)
    bad, fine, open_ = np.zeros((3, len(texts)))
    for share, at in held:
        (bad if share > 0.5 else fine if 0 <= share < 0.5 else open_)[at] += 1
    for r in range(rounds + 1):
        f = scores(texts, weights, bias)
        if r == 0:
            plus, minus = bad, fine + UNJUDGED_WEIGHT * open_
        else:
            plus = np.zeros(len(texts))
            for share, at in held:
                if at and (share > 0.5 or share < 0 and r > 1):
                    worst = at[int(np.argmax(f[at]))]
                    plus[worst] += 1 if share > 0.5 else 0.5 * (f[worst] > CLEAR)
            minus = np.where(f < SURE, fine, 0) + np.where(f < 0, bad + UNJUDGED_WEIGHT * open_, 0)
            minus = np.where(plus > 0, np.minimum(minus, fine), minus)
        y = np.where(plus > minus, 1.0, -1.0)
        times = np.minimum(np.abs(plus - minus), 5.0)
        pos = np.flatnonzero((y > 0) & (times > 0))
        neg = np.flatnonzero((y < 0) & (times > 0))
        pos = rng.permutation(pos)[: max_sentences // 3]
        room = max_sentences - len(pos)
        order = neg[np.argsort(-f[neg], kind="stable")]
        hard = order[: room // 2]
        rest = rng.permutation(order[room // 2 :])[: room - len(hard)]
        rows_ = np.concatenate([pos, hard, rest]).astype(int)
        units, labels = seeds + [texts[i] for i in rows_], np.concatenate([seed_labels, y[rows_]])
        weights, bias = train_svm(units, labels, np.concatenate([seed_times, times[rows_]]), c=FIRST_C if r == 0 else C)
    return weights, bias


def _units(documents: DataFrame) -> DataFrame:
    """(share, units) of documents (share, text): the distinct normalised sentences of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = [list(dict.fromkeys(sentences(t))) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["share"], pa.array(units, pa.list_(pa.string()))], names=["share", "units"])

    return documents.select("share", "text").mapInArrow(run, "share double, units array<string>")


def train(documents: DataFrame | None, labels: DataFrame | None, max_documents: int = 8000, max_unlabelled: int = 4000, max_chars: int = 30_000_000, max_sentences: int = 14_000) -> tuple[np.ndarray, float]:
    """Train on the built-in sentences and on a bounded sample: at most `max_documents` reviewed documents and `max_unlabelled`
    others, in the order of a hash of their ids, each whole, up to `max_chars` characters in all; a round of `fit` takes at most
    `max_sentences` windows of theirs. Without documents or reviews the built-in sentences alone count."""
    if documents is None or labels is None:
        return fit([])
    texts = documents.select("doc_id", "text").filter("text is not null and doc_id is not null")
    verdicts = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.avg((F.col("verdict") == "unwanted").cast("int")).alias("share"))
    first = lambda d, n: d.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    others = texts.select("doc_id").join(verdicts.select("doc_id"), "doc_id", "left_anti")
    # Only ids are sorted; the two samples have a fixed number of rows.
    sample = cut(first(verdicts, max_documents).unionByName(first(others, max_unlabelled).withColumn("share", F.lit(-1.0))))
    rows = texts.join(F.broadcast(sample), "doc_id")
    before = W.orderBy(F.col("share") < 0, F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_chars", F.sum(F.length("text")).over(before)).filter(F.col("_chars") <= max_chars).drop("_chars")
    return fit([(r["share"], r["units"]) for r in _units(rows.repartition(8)).collect()], max_sentences)


def document_scores(documents: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, source, score) of every document: the highest decision value of its sentences; a text without a sentence
    (null, empty, signs only) scores null."""
    sent = documents.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = sent.value
        for b in batches:
            ids, sources, texts = b["doc_id"], b["source"], b["text"].to_pylist()
            out = np.full(len(texts), np.nan)
            for lo in range(0, len(texts), 500):
                units, owner = [], []
                for i, t in enumerate(texts[lo : lo + 500]):
                    us = sentences(t) if t else []
                    units += us
                    owner += [lo + i] * len(us)
                if units:
                    np.fmax.at(out, np.array(owner), scores(units, w, b0))
            yield pa.RecordBatch.from_arrays([ids, sources, pa.array(out, mask=np.isnan(out))], names=["doc_id", "source", "score"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, score double")


def source_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, unwanted documents and their rate per source (null sources form one group)."""
    bad = F.coalesce(F.col("score") > threshold, F.lit(False)).cast("int")
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(bad).alias("unwanted"), F.avg(bad).alias("rate"))


def found(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents with a sentence above the threshold."""
    return document_scores(documents, *train(documents, labels)).filter(F.col("score") > threshold).select("doc_id").distinct()
