"""Frequency of every term and n-gram by a distributed suffix array (problem 2).

Each value is a sequence of words between two end marks. All suffixes of all values are sorted by range
over the cluster; in sorted order the suffixes that begin with one n-gram are one interval, found where
the common prefix with the neighbour before is shorter than n. The interval's size is the number of
occurrences; its size less the adjacent repeats of one record (after ordering the interval by record) is
the number of records. Intervals that touch the edge of a partition go on in the next one, so their
records are kept and stitched afterwards. Nothing is collected or sampled.

n-grams of every length have a row, so suffixes are kept whole: half the square of a value's words, which
the rows of its n-grams exceed (copies of one value apart). Tasks are sized by the characters of their
suffixes, and a task takes them in runs of RUN characters, whose edges are stitched like those of ranges.
Where only whole values are asked for, a suffix is kept to its first DEPTH words, and the one that is the
whole value keeps the rest behind them as one last part: a long value costs as much as its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

BEGIN, END, SEP = "\x02", "\x03", "\x00"
DEPTH = 32
RUN = 16_000_000

_OUT = "field string, ngram string, n int, occurrences long, records long, record string"


class _Range:
    """One run of a sorted range of the suffix array: words as numbers end to end, and the words each suffix shares with the one before."""

    def __init__(self, part: pd.DataFrame):
        self.suffixes = part["suffix"].tolist()
        self.fields = part["field"].to_numpy(object)
        self.names = part["record"].to_numpy(object)
        self.record = pd.factorize(self.names)[0]
        flat = SEP.join(self.suffixes).split(SEP)
        self.length = np.fromiter((s.count(SEP) + 1 for s in self.suffixes), np.int64, len(self.suffixes))
        self.first = np.r_[0, np.cumsum(self.length)[:-1]]
        self.chars = np.r_[0, np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1)]
        ids, words = pd.factorize(np.array(flat, dtype=object))
        begin = np.flatnonzero(words == BEGIN)
        self.whole = ids[self.first] == (begin[0] if len(begin) else -1)
        field = pd.factorize(self.fields)[0]
        self.common = np.zeros(len(self.suffixes), np.int64)
        alive, k = np.flatnonzero(field[1:] == field[:-1]) + 1, 0
        while len(alive):
            alive = alive[(self.length[alive] > k) & (self.length[alive - 1] > k)]
            alive = alive[ids[self.first[alive] + k] == ids[self.first[alive - 1] + k]]
            self.common[alive] += 1
            k += 1

    def prefix(self, i: int, n: int) -> str:
        return self.suffixes[i][: self.chars[self.first[i] + n] - self.chars[self.first[i]] - 1]

    def intervals(self, at: np.ndarray, new: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
        """Rows of the intervals over the suffixes ``at``; ``new`` says where one begins, ``n`` its words."""
        group = np.cumsum(new) - 1
        heads = at[np.flatnonzero(new)]
        order = np.lexsort((self.record[at], group))
        g, r = group[order], self.record[at][order]
        repeat = np.r_[False, (g[1:] == g[:-1]) & (r[1:] == r[:-1])] | (r < 0)
        size = np.bincount(group)
        records = size - np.bincount(g, weights=repeat).astype(np.int64)
        ngram = np.array([self.prefix(h, k) for h, k in zip(heads.tolist(), n.tolist())], dtype=object)
        edge = np.zeros(len(heads), bool)
        if at[0] == 0:
            edge[0] = True
        if at[-1] == len(self.suffixes) - 1:
            edge[-1] = True
        closed = ~edge
        if closed.any():
            yield pd.DataFrame({"field": self.fields[heads[closed]], "ngram": ngram[closed], "n": n[closed].astype(np.int32), "occurrences": size[closed], "records": records[closed], "record": None})
        if edge.any():
            sel = np.flatnonzero(edge[g])  # a record's occurrences in one row
            h = sel[np.r_[True, (g[sel[1:]] != g[sel[:-1]]) | (r[sel[1:]] != r[sel[:-1]])]]
            times = np.diff(np.r_[np.searchsorted(sel, h), len(sel)])
            yield pd.DataFrame({"field": self.fields[at[order[h]]], "ngram": ngram[g[h]], "n": n[g[h]].astype(np.int32), "occurrences": times, "records": np.int64(0), "record": self.names[at[order[h]]]})


def _runs(blocks: Iterator[pd.DataFrame], chars: int) -> Iterator[pd.DataFrame]:
    """The sorted suffixes of one task, end to end, in runs of about ``chars`` characters."""
    held, last, done = [], 0, 0
    for b in blocks:
        if len(b):
            ends = done + np.cumsum(np.fromiter(map(len, b["suffix"]), np.int64, len(b)))
            done = int(ends[-1])
            for number, piece in b.groupby(ends // chars):
                if held and number != last:
                    yield pd.concat(held, ignore_index=True)
                    held.clear()
                held.append(piece)
                last = number
    if held:
        yield pd.concat(held, ignore_index=True)


def _intervals(values_only: bool, depth: int | None, chars: int):
    """Common-prefix intervals of one sorted range of the suffix array; with ``values_only`` only those of whole values go out."""

    def one(part: _Range) -> Iterator[pd.DataFrame]:
        at = np.flatnonzero(part.whole)
        if len(at):  # a whole value ends in a mark that nothing follows: its interval are its equals
            new = part.common[at] < part.length[at]
            new[0] = True
            yield from part.intervals(at, new, part.length[at[new]])
        if values_only:
            return
        longest = int(part.length.max())
        long = np.arange(len(part.suffixes))
        for n in range(1, min(depth or longest, longest) + 1):
            # suffixes shorter than n sort before those of an interval, never between them; whole values have their rows
            long = long[part.length[long] >= n]
            at = long[~(part.whole[long] & (part.length[long] == n))]
            if len(at):
                new = part.common[at] < n
                yield from part.intervals(at, new, np.full(int(new.sum()), n))

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _runs(blocks, chars):
            yield from one(_Range(rows))

    return run


def ngram_counts(items: DataFrame, scratch: Scratch, per_task: int = 250_000, values_only: bool = False, depth: int | None = None) -> DataFrame:
    """(field, ngram, n, occurrences, records) of every word n-gram and whole value of ``items`` (field, record, term).

    ``term`` is a normal form; words are its parts between blanks. n-grams with the marks BEGIN and END
    at their ends are whole values, see :func:`value_counts`; ``values_only`` leaves out all other rows,
    ``depth``, if a caller gives it, those of inner n-grams of more words. Null and empty terms count
    nowhere; a null record's terms occur but add no record. ``per_task`` suffixes, or RUN characters of
    whole ones, are sorted in one task; the range key ends in the record, so that one term with a third of
    all rows is spread over many tasks. Empty input gives no rows.
    """
    term = F.translate("term", BEGIN + END + SEP, "")
    words = F.concat(F.array(F.lit(BEGIN)), F.split(term, " "), F.array(F.lit(END)))
    kept = depth or (DEPTH if values_only else None)
    if kept:
        rest = F.array_join(F.slice("w", kept + 1, F.greatest(F.size("w") - kept - 1, F.lit(1))), " ")
        whole = F.when(F.size("w") <= kept + 1, F.array_join("w", SEP)).otherwise(F.concat_ws(SEP, F.array_join(F.slice("w", 1, kept), SEP), rest, F.lit(END)))
        suffix = F.when(F.col("i") == 1, whole).otherwise(F.array_join(F.slice("w", F.col("i"), kept), SEP))
    else:
        suffix = F.array_join(F.slice("w", F.col("i"), F.size("w")), SEP)
    suffixes = (
        items.where(F.length(term) > 0)
        .select("field", "record", words.alias("w"))
        .select("field", "record", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i"))
        .select("field", "record", suffix.alias("suffix"))
    )
    entries = scratch.cut(suffixes, "suffixes")
    rows, chars = (entries.count(), 0) if kept else entries.agg(F.count("suffix"), F.coalesce(F.sum(F.length("suffix")), F.lit(0))).first()
    tasks = max(1, math.ceil(max(rows / per_task, chars / RUN)))
    key = ["field", "suffix", "record"]
    ranged = entries.repartitionByRange(tasks, *key).sortWithinPartitions(*key)
    found = scratch.cut(ranged.mapInPandas(_intervals(values_only, depth, RUN), _OUT), "intervals")
    closed = found.where(F.col("record").isNull() & (F.col("records") > 0)).select("field", "ngram", "n", "occurrences", "records")
    open_ = found.where(~(F.col("record").isNull() & (F.col("records") > 0)))
    stitched = (
        open_.groupBy("field", "ngram", "n", "record")
        .agg(F.sum("occurrences").alias("occurrences"))
        .groupBy("field", "ngram", "n")
        .agg(F.sum("occurrences").alias("occurrences"), F.count("record").alias("records"))
    )
    return closed.unionByName(stitched)


def value_counts(counts: DataFrame) -> DataFrame:
    """(field, term, occurrences, records) of whole values, from :func:`ngram_counts`."""
    whole = counts.where(F.col("ngram").startswith(BEGIN) & F.col("ngram").endswith(END))
    inner = F.expr("substring(ngram, 3, length(ngram) - 4)")
    return whole.select("field", F.translate(inner, SEP, " ").alias("term"), "occurrences", "records")


def marked(values: DataFrame, total_records: DataFrame, rare: int = 2, common: float = 0.15) -> DataFrame:
    """Adds ``mark``: 'rare' up to ``rare`` records, 'common' above that share of ``total_records`` (one row, one column ``total``), else null; in tiny collections 'rare' goes first."""
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * F.col("total"), "common")
    return values.crossJoin(F.broadcast(total_records)).select("field", "term", "occurrences", "records", mark.alias("mark"))
