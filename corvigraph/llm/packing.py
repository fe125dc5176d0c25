"""Filling containers of fixed capacity by bound-certified repacking (problem 6).

Items are dealt by hash into partitions of bounded size. Each partition packs by best-fit decreasing and
computes lower bounds of its bin count from dual-feasible functions; where count and bound agree, the
partition is certified, and all its bins but the emptiest are done. A partition with a gap keeps its fuller
bins and gives the documents of its emptiest, eight for each bin of the gap, into the exchange, as all give
their emptiest one. What is in the exchange is dealt anew over partitions of the same bounded size and
packed again, until one partition holds it or a round saves no bin. Every document of a bin that is given
takes part; no partition ever grows beyond its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

CAPACITY = 4096
#: Pieces that are packed in one task.
PER_PARTITION = 4_000
#: Largest k of the rounding functions u_k tried for a bound. More of them could only raise a bound.
MOST_K = 100
#: Bins that a partition gives into the exchange for each bin of its gap.
GIVEN = 8


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY, counts: np.ndarray | None = None) -> int:
    """Bins that any packing of ``sizes``, each ``counts`` times, needs: the best of several dual-feasible functions.

    A function u on [0, 1] is dual feasible if sizes that fit in one bin have values of at most 1 in sum,
    so that the sum of all values bounds the bins. Tried are the identity, the family that raises sizes
    above 1 - e to 1 and drops those below e, and the roundings floor((k + 1) x) / k.
    """
    if not len(sizes):
        return 0
    order = np.argsort(sizes, kind="stable")
    s = np.asarray(sizes, np.int64)[order]
    n = np.ones(len(s), np.int64) if counts is None else np.asarray(counts, np.int64)[order]
    best = -(-int((s * n).sum()) // capacity)
    total, number = np.r_[0, np.cumsum(s * n)], np.r_[0, np.cumsum(n)]
    small = np.unique(s[2 * s <= capacity])
    low = np.searchsorted(s, small, "left")
    high = np.searchsorted(s, capacity - small, "right")
    values = (total[high] - total[low]) + (number[-1] - number[high]) * capacity  # for each e: the sizes from e to 1 - e, and bins of their own
    if len(values):
        best = max(best, int(-(-values.max() // capacity)))
    best = max(best, int(n[2 * s > capacity].sum()))
    for k in range(1, MOST_K + 1):
        scaled = (k + 1) * s
        exact = scaled % capacity == 0
        # k * capacity * u_k: k * s where (k + 1) x is whole, else capacity * floor((k + 1) x)
        value = (np.where(exact, k * s, capacity * (scaled // capacity)) * n).sum()
        best = max(best, int(-(-int(value) // (k * capacity))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each item. A bit per free space finds the fullest bin that still takes an item."""
    order = np.argsort(-np.asarray(sizes), kind="stable")
    bins = np.empty(len(sizes), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, count = 0, 0
    for i in order.tolist():
        size = int(sizes[i])
        fits = free >> size
        if fits:
            space = size + ((fits & -fits).bit_length() - 1)
            b = open_[space].pop()
            if not open_[space]:
                free &= ~(1 << space)
        else:
            b, space, count = count, capacity, count + 1
        bins[i] = b
        left = space - size
        open_[left].append(b)
        free |= 1 << left
    return bins


def _cut_points(data: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(first byte, bytes, tokens) of the pieces of a text: whole characters, the closing token at the end."""
    at, n = 0, len(data)
    while n - at + 1 > capacity:
        end = at + capacity
        while end < n and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield at, end - at, end - at
        at = end
    yield at, n - at, n - at + 1


def sized_pieces(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece_no, first_byte, bytes, tokens) of texts: one piece unless the text is larger than a container.

    A text's size is one token for each UTF-8 byte and one closing token. Null text has no size and is
    left out; an empty text is a piece of one token. Only larger texts leave the JVM.
    """
    if capacity < 4:
        raise ValueError("a container must hold any character")
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text", F.octet_length("text").cast("long").alias("n"))
    whole = texts.where(F.col("n") + 1 <= capacity).select("doc_id", F.lit(1).alias("piece_no"), F.lit(0).cast("long").alias("first_byte"), F.col("n").alias("bytes"), (F.col("n") + 1).alias("tokens"))

    def cut(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            rows = [(d, i, *p) for d, t in zip(block["doc_id"], block["text"]) for i, p in enumerate(_cut_points(t.encode(), capacity), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "first_byte", "bytes", "tokens"])

    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, piece_no int, first_byte long, bytes long, tokens long"
    return whole.unionByName(texts.where(F.col("n") + 1 > capacity).select("doc_id", "text").mapInPandas(cut, schema))


def _packer(number: int, final: bool, capacity: int, columns: list[str]):
    """Packs one partition; says which of its bins are done and where each piece lies."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = pdf["tokens"].to_numpy(np.int64)
        bins = best_fit_decreasing(sizes, capacity)
        used, bound = int(bins.max()) + 1, lower_bound(sizes, capacity)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        done = np.full(used, True)
        if not final:
            poor = np.argsort(fill, kind="stable")[: max(1, GIVEN * (used - bound))]
            done[poor] = fill[poor] == capacity
        order = np.argsort(bins, kind="stable")
        place = np.empty(len(bins), np.int64)
        starts = np.r_[0, np.cumsum(np.bincount(bins))[:-1]]
        place[order] = np.arange(len(bins)) - starts[bins[order]] + 1
        return pdf.assign(round=number, bin=bins, place=place, fill=fill[bins], done=done[bins], items=len(pdf), used=used, bins=int(done.sum()), bound=bound)[columns]

    return one


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> tuple[DataFrame, DataFrame]:
    """(placed, report). placed: ``pieces`` with container and place; report: (round, part, items, tokens, used, bins, bound).

    ``pieces`` has doc_id, piece_no, first_byte, bytes, tokens (1 to ``capacity``). About ``per_partition``
    pieces are packed in one task. Containers are strings, unique over all rounds; place counts from 1.
    report has a row for each partition of each round: the bins it ``used``, those it closed (``bins``) and
    the certified ``bound``. Two numbers a round come to the driver.
    """
    count = pieces.count()
    parts = max(1, math.ceil(count / per_partition))
    typed = dict(pieces.dtypes)["doc_id"]
    item = f"doc_id {typed}, piece_no int, first_byte long, bytes long, tokens long"
    schema = f"round int, part long, bin long, place int, fill long, done boolean, items int, used int, bins int, bound int, {item}"
    columns = [c.split()[0] for c in schema.split(", ")]
    names = ["doc_id", "piece_no", "first_byte", "bytes", "tokens"]
    deal = lambda df, number, parts: df.select(*names, F.pmod(F.xxhash64(F.lit(number), "doc_id", "piece_no", "first_byte"), F.lit(parts)).alias("part"))
    left = deal(pieces, 0, parts)
    placed, reports, number, given = None, None, 0, None
    while True:
        final = parts == 1
        packed = scratch.cut(left.groupBy("part").applyInPandas(_packer(number, final, capacity, columns), schema), f"round{number}")
        report = packed.groupBy("round", "part").agg(F.first("items").alias("items"), F.sum("tokens").alias("tokens"), F.first("used").alias("used"), F.first("bins").alias("bins"), F.first("bound").alias("bound"))
        reports = report if reports is None else reports.unionByName(report)
        used, closed = report.agg(F.coalesce(F.sum("used"), F.lit(0)), F.coalesce(F.sum("bins"), F.lit(0))).first()
        over = final or given is not None and used >= given  # a round that saves nothing is the last
        done = packed if over else packed.where("done")
        placed = done if placed is None else placed.unionByName(done)
        if over:
            break
        rest = packed.where("NOT done")
        number, given = number + 1, used - closed
        parts = max(1, math.ceil(rest.count() / per_partition))
        left = deal(rest, number, parts)
    out = placed.select(F.concat_ws("-", "round", "part", "bin").alias("container"), "place", "fill", *names)
    return out, reports


def whole_bound(pieces: DataFrame, capacity: int = CAPACITY) -> int:
    """Bins that any packing of all ``pieces`` needs. Its input is one row for each size, so at most ``capacity`` rows come to the driver."""
    sizes = pieces.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).toPandas()
    return lower_bound(sizes["tokens"].to_numpy(np.int64), capacity, sizes["n"].to_numpy(np.int64))
