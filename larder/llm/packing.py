"""Filling containers of fixed capacity, by bulk-synchronous best-fit.

Pieces are range-sorted by size, and partition counts give each its exact rank among the pieces of its size. Pieces of one
size, and gaps of one size, are exchangeable, so a round works on at most `capacity` sizes with counts: a successor sweep
over the sorted sizes matches every open gap, smallest first, with the largest piece that fits and is left; of equal
candidates the lower ranks win; gaps are updated and the round repeats until nothing fits. Then containers are opened for the largest
pieces left, as many as their total needs, and so on. The result of all rounds is a list of runs "ranks r..r+n of size s go to containers
c..c+n at offset o", whose length depends on the capacity and the number of rounds, not on the number of documents; each
task looks up its pieces in it. Documents are shuffled once, for the sort.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.session import cut

CAPACITY = 2048
TOKENIZERS = os.environ.get("LARDER_TOKENIZERS", "/opt/tokenizers")


NAME = "byte_bpe_50k.tiktoken"


def encoder(path: str | None = None):
    """A byte-level BPE from a vocabulary file of ranks (default: the one in TOKENIZERS)."""
    import tiktoken

    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    with open(path or f"{TOKENIZERS}/{NAME}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(NAME, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, tokens) of every document; null and empty texts have 0 tokens. The vocabulary file is shipped to the executors."""
    docs.sparkSession.sparkContext.addFile(f"{folder}/{NAME}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(NAME))
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int32())], names=["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, tokens int")


def pieces(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, tokens): a document up to the capacity is one piece, a longer one is cut into full pieces and a rest."""
    n = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)).cast("int")
    cutted = sizes.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return cutted.select("doc_id", "piece", F.least(F.col("tokens") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("tokens"))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (size, first rank, number, first container, offset) for `counts` pieces of each size, and the number of containers."""
    left = {s: n for s, n in counts.items() if n > 0 and s > 0}
    rank: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap -> [first container, number]
    runs: list[tuple[int, int, int, int, int]] = []
    containers = 0

    def take(size: int, first: int, number: int, gap: int) -> None:
        runs.append((size, rank[size], number, first, capacity - gap))
        rank[size] += number
        left[size] -= number
        if not left[size]:
            del left[size]
        if gap > size:
            gaps[gap - size].append([first, number])

    def open_for(size: int, number: int) -> None:
        nonlocal containers
        take(size, containers, number, capacity)
        containers += number

    while left:
        # Pieces over half the capacity need a container each; later, as many as the rest needs at least, for the largest pieces.
        big = [s for s in left if 2 * s > capacity]
        if big:
            for s in sorted(big, reverse=True):
                open_for(s, left[s])
        else:
            free = sum(g * n for g, rs in gaps.items() for _, n in rs)
            need = max(1, -(-max(0, sum(s * n for s, n in left.items()) - free) // capacity))
            for s in sorted(left, reverse=True):
                n = min(left[s], need)
                open_for(s, n)
                need -= n
                if need <= 0:
                    break
        while left and gaps:
            order = sorted(left)
            new = {g: rs for g, rs in gaps.items() if rs}
            gaps = defaultdict(list)
            moved = False
            for g in sorted(new):
                for first, number in new[g]:
                    while number:
                        i = bisect_right(order, g) - 1
                        while i >= 0 and order[i] not in left:
                            del order[i]
                            i -= 1
                        if i < 0:
                            break
                        n = min(number, left[order[i]])
                        take(order[i], first, n, g)
                        first, number, moved = first + n, number - n, True
                    if number:
                        gaps[g].append([first, number])
            if not moved:
                break
    if counts.get(0):
        runs.append((0, 0, counts[0], 0, 0))  # empty texts need no room: all go to the first container
        containers = max(containers, 1)
    return runs, containers


def ranked(parts: DataFrame) -> DataFrame:
    """`parts` with the exact 0-based `rank` of each piece among those of its size (order: doc_id, piece)."""
    # The sort is random in its splits only: the checkpoint fixes the partition of each row.
    placed = cut(parts.repartitionByRange("tokens", "doc_id", "piece").withColumn("_part", F.spark_partition_id()))
    here = placed.groupBy("tokens", "_part").count()
    before = W.partitionBy("tokens").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    here = here.select("tokens", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_n0"))
    inside = W.partitionBy("tokens", "_part").orderBy("doc_id", "piece")
    return placed.withColumn("_i", F.row_number().over(inside) - 1).join(here, ["tokens", "_part"]).select("doc_id", "piece", "tokens", (F.col("_n0") + F.col("_i")).alias("rank"))


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, tokens, container, offset) for every piece (sizes 0..capacity); pieces of a container do not overlap.

    The counts per size, at most `capacity` + 1 numbers, are all that reaches the driver. Empty input gives no rows."""
    placed = ranked(parts)
    counts = {r["tokens"]: r["n"] for r in parts.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    table: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for size, first_rank, _, first, offset in runs:
        table[size].append((first_rank, first, offset))
    table = {s: np.array(sorted(rows), dtype=np.int64) for s, rows in table.items()}
    sent = parts.sparkSession.sparkContext.broadcast(table)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b["tokens"].to_numpy(), b["rank"].to_numpy()
            container, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int32)
            for s in np.unique(size).tolist():
                rows = np.flatnonzero(size == s)
                runs = sent.value[s]
                at = np.searchsorted(runs[:, 0], rank[rows], side="right") - 1
                container[rows] = runs[at, 1] + (rank[rows] - runs[at, 0] if s else 0)
                offset[rows] = runs[at, 2]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["piece"], b["tokens"], pa.array(container), pa.array(offset)], names=["doc_id", "piece", "tokens", "container", "offset"])

    return placed.mapInArrow(look_up, "doc_id long, piece int, tokens int, container long, offset int")


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS) -> DataFrame:
    """Containers for the texts of `docs`, each tokenised once."""
    return pack(pieces(cut(token_counts(docs, folder)), capacity), capacity)
