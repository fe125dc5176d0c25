"""Cutting oversized items into overlapping pieces at natural boundaries, by byte ranges (problem 3).

An item is the bytes of a text cell or of a file. It is seen as ranges of a fixed number of bytes with a
halo of three, which is all that a boundary needs to see of the next range; files are opened and read at a
range's offset, never as a whole. Each range yields a small table: its characters and the offsets behind
its boundaries, prefix sums within the range. A pass over these tables in range order stitches them:
it adds up the characters of the ranges before, and chooses the cuts, holding no more than a few pieces'
worth of boundaries however long the item is. Pieces are then emitted by offset, range by range; only
those that span ranges are put together. Offsets are 64-bit characters of the item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 120
#: Bytes of a range of a text cell, and of a file.
RANGE, FILE_RANGE = 8192, 8 << 20
#: Bytes seen behind a range: a character that begins in it, or the white space behind its last sign, ends there.
HALO = 3

# UTF-8 forms of white space: tab to carriage return, the four separators, blank, next line, and all of class Z.
_SPACE = rb"[\t-\r\x1c-\x1f ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_INNER = re.compile(rb"[\n\r]|[.!?](?=" + _SPACE + rb")")
_FINAL = re.compile(rb"[\n\r]|[.!?](?=" + _SPACE + rb"|\Z)")


def _fields(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.select(*keys).dtypes)


def text_ranges(texts: DataFrame, keys: list[str], text: str = "text", size: int = RANGE) -> DataFrame:
    """(keys, range_no, last, part) of text cells: bytes of each range with its halo. Null texts have no ranges, empty ones one."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(text) / size)).cast("long")
    return (
        texts.where(F.col(text).isNotNull())
        .select(*keys, F.col(text).cast("binary").alias("_all"), count.alias("_n"))
        .select(*keys, "_all", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("range_no"))
        .select(*keys, "range_no", (F.col("range_no") == F.col("_n") - 1).alias("last"), F.substring("_all", (F.col("range_no") * size + 1).cast("int"), F.lit(size + HALO)).alias("part"))
    )


def file_table(spark: SparkSession, paths: list[str], size: int = FILE_RANGE) -> DataFrame:
    """(path, length, range_no, last) of the ranges of files; no content is read. Ranges are spread over all tasks."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    count = F.greatest(F.lit(1), F.ceil(F.col("length") / size)).cast("long")
    rows = files.select("path", "length", count.alias("n")).select("path", "length", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("range_no"))
    return rows.select("path", "length", "range_no", (F.col("range_no") == F.col("n") - 1).alias("last")).repartition("path", "range_no")


def _bytes_at(path: str, start: int, count: int) -> bytes:
    from pyarrow import fs

    uri = re.sub(r"\Afile:/+", "file:///", path)
    system, inner = fs.FileSystem.from_uri(uri)
    with system.open_input_file(inner) as f:
        f.seek(start)
        return f.read(count)


def file_ranges(spark: SparkSession, paths: list[str], size: int = FILE_RANGE) -> DataFrame:
    """(path, range_no, last, part) of files: each range read at its offset, with its halo."""

    def read(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            for path, no, last in block.itertuples(index=False):
                yield pd.DataFrame({"path": [path], "range_no": [no], "last": [last], "part": [_bytes_at(path, no * size, size + HALO)]})

    return file_table(spark, paths, size).select("path", "range_no", "last").mapInPandas(read, "path string, range_no long, last boolean, part binary")


def _starts(part: bytes, size: int) -> np.ndarray:
    """Where characters begin in a range's own bytes."""
    return np.flatnonzero((np.frombuffer(part, np.uint8)[:size] & 0xC0) != 0x80)


def boundary_table(ranges: DataFrame, keys: list[str], size: int = RANGE) -> DataFrame:
    """(keys, range_no, last, chars, ends): of each range its characters and, ascending, how many lie up to and with each boundary.

    A boundary is one character: a line feed or carriage return, or . ! ? before white space or the end.
    """

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            chars, ends = [], []
            for part, last in zip(block["part"], block["last"]):
                starts = _starts(part, size)
                at = np.fromiter((m.start() for m in (_FINAL if last else _INNER).finditer(part)), np.int64)
                chars.append(len(starts))
                ends.append(np.searchsorted(starts, at[at < size], side="right").astype(np.int64))
            yield block.drop(columns="part").assign(chars=np.array(chars, np.int64), ends=ends)

    return ranges.select(*keys, "range_no", "last", "part").mapInPandas(run, f"{_fields(ranges, keys)}, range_no long, last boolean, chars long, ends array<long>")


class _Cutter:
    """Cuts of one item, from its boundary tables in order.

    A piece ends at the last boundary within its limit. The next one begins at most ``overlap`` characters
    before that end, at a boundary if there is one, and with less overlap where the next stretch would
    otherwise not fit. A stretch that fits in no piece is cut at the limit: forced. ``over`` says whether it
    is too long even without its boundary sign.
    """

    def __init__(self, limit: int, overlap: int):
        self.limit, self.overlap = limit, overlap
        self.start = self.done = self.total = 0
        self.ends = np.empty(0, np.int64)
        self.ranges: list[tuple[int, int, int]] = []  # number, characters before it, characters in it

    def feed(self, range_no: int, chars: int, ends: np.ndarray, last: bool) -> Iterator[tuple[int, int, bool, bool, list[tuple[int, int, int]]]]:
        """(start, end, forced, over, [(range_no, low, high)]) of the pieces that are certain once this range is known."""
        self.ends = np.concatenate([self.ends, np.asarray(ends, np.int64) + self.total])
        self.ranges.append((range_no, self.total, chars))
        self.total += chars
        if last and self.total <= self.limit:
            return
        while self.done < self.total and (last or self.total > self.start + 2 * self.limit + 1):
            if last and self.total <= self.start + self.limit:
                yield self._piece(self.total, False, False)
                self.done = self.total
                return
            most = self.start + self.limit
            k = int(np.searchsorted(self.ends, most, side="right"))
            end = int(self.ends[k - 1]) if k else 0
            forced, over = end <= self.done, False
            if forced:
                end = most
                over = (int(self.ends[k]) - 1 if k < len(self.ends) else self.total) - self.done > self.limit
            piece = self._piece(end, forced, over)
            j = int(np.searchsorted(self.ends, end, side="right"))
            stretch = (int(self.ends[j]) if j < len(self.ends) else self.total) - end
            run = stretch - (j < len(self.ends))  # without the boundary sign
            reach = max(0, min(self.overlap, self.limit - stretch)) if run <= self.limit else self.overlap
            reach = min(reach, end - self.start - 1)  # never the whole piece before
            j = int(np.searchsorted(self.ends, end - reach, side="left"))
            self.start = int(self.ends[j]) if j < len(self.ends) and self.ends[j] < end else end - reach
            self.done = end
            self.ends = self.ends[np.searchsorted(self.ends, self.start, side="left") :]
            self.ranges = [r for r in self.ranges if r[1] + r[2] > self.start]
            yield piece

    def _piece(self, end: int, forced: bool, over: bool):
        spans = [(no, max(self.start - base, 0), min(end - base, n)) for no, base, n in self.ranges if base < end and base + n > self.start]
        return self.start, end, forced, over, spans


def choose_cuts(length: int, ends: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of each piece of an item whose boundaries are all at hand; none up to ``limit``."""
    return [p[:3] for p in _Cutter(limit, overlap).feed(0, length, ends, True)]


def cut_table(ranges: DataFrame, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """(keys, piece_no, start, end, forced, over, spans) of all items longer than ``limit``; piece_no from 0.

    ``spans`` are (range_no, low, high): the piece's characters in each range that holds some. An item's
    boundary tables meet in one task, sorted, and stream through it; repeated rows of a range count once.
    """
    if overlap >= limit:
        raise ValueError("overlap must be below limit")
    tables = boundary_table(ranges, keys, size).repartition(*keys).sortWithinPartitions(*keys, "range_no")

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item, cutter, number, before = None, None, 0, -1
        for block in blocks:
            rows = []
            for *key, no, last, chars, ends in block[[*keys, "range_no", "last", "chars", "ends"]].itertuples(index=False):
                key = tuple(None if k is None or k != k else k for k in key)
                if cutter is None or key != item:
                    item, cutter, number, before = key, _Cutter(limit, overlap), 0, -1
                if no == before:
                    continue
                before = no
                for start, end, forced, over, spans in cutter.feed(no, chars, ends, last):
                    rows.append((*key, number, start, end, forced, over, [{"range_no": r, "low": a, "high": b} for r, a, b in spans]))
                    number += 1
            yield pd.DataFrame(rows, columns=[*keys, "piece_no", "start", "end", "forced", "over", "spans"])

    return tables.mapInPandas(run, f"{_fields(ranges, keys)}, piece_no int, start long, end long, forced boolean, over boolean, spans array<struct<range_no: long, low: long, high: long>>")


def longest_stretch(ranges: DataFrame, keys: list[str], size: int = RANGE) -> DataFrame:
    """(keys, length, stretch): the longest run of characters without a boundary. A plain check of :func:`cut_table`: it gathers an item's boundaries."""
    tables = boundary_table(ranges, keys, size)

    @F.pandas_udf("length long, stretch long")
    def run(parts: pd.Series) -> pd.DataFrame:
        rows = []
        for found in parts:
            base, ends = 0, [np.zeros(1, np.int64)]
            for r in found:
                ends.append(np.asarray(r["ends"], np.int64) + base)
                base += r["chars"]
            ends = np.concatenate(ends)
            rows.append((base, max(np.r_[ends[1:] - 1, base] - ends)))
        return pd.DataFrame(rows, columns=["length", "stretch"])

    return tables.groupBy(*keys).agg(run(F.array_sort(F.collect_set(F.struct("range_no", "chars", "ends")))).alias("s")).select(*keys, "s.length", "s.stretch")


def _wanted(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, range_no, wanted): what is to be taken from each range."""
    w = cuts.select(*keys, "piece_no", "start", "end", "forced", (F.size("spans") > 1).alias("several"), F.explode("spans").alias("s"))
    return w.groupBy(*keys, "s.range_no").agg(F.collect_list(F.struct("piece_no", "start", "end", "forced", "several", "s.low", "s.high")).alias("wanted"))


def _emit(keys: list[str], size: int, part_of):
    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            for row in block.to_dict("records"):
                part = part_of(row)
                starts = np.r_[_starts(part, size), 0]
                starts[-1] = next((i for i in range(min(size, len(part)), len(part)) if part[i] & 0xC0 != 0x80), len(part))  # the last character may end in the halo
                bits = [part[starts[w["low"]] : starts[w["high"]]] for w in row["wanted"]]
                out = pd.DataFrame([(w["piece_no"], w["start"], w["end"], w["forced"], w["several"], row["range_no"], bit.decode("utf-8", "replace")) for w, bit in zip(row["wanted"], bits)], columns=["piece_no", "start", "end", "forced", "several", "range_no", "bit"])
                for i, k in enumerate(keys):
                    out.insert(i, k, row[k])
                yield out

    return run


def _joined(bits: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces from their bits: those of one range as they are, the others put together."""
    cols = [*keys, "piece_no", "start", "end", "forced"]
    whole = bits.where("NOT several").select(*cols, F.col("bit").alias("piece"))
    spread = bits.where("several").groupBy(*cols).agg(F.array_sort(F.collect_list(F.struct("range_no", "bit"))).alias("bits"))
    return whole.unionByName(spread.select(*cols, F.array_join(F.col("bits.bit"), "").alias("piece")))


def _bit_schema(df: DataFrame, keys: list[str]) -> str:
    return f"{_fields(df, keys)}, piece_no int, start long, end long, forced boolean, several boolean, range_no long, bit string"


def pieces_of_ranges(ranges: DataFrame, cuts: DataFrame, keys: list[str], size: int = RANGE) -> DataFrame:
    """(keys, piece_no, start, end, forced, piece): the cuts' characters, from the ranges that hold them. Repeated rows of a range count once."""
    once = ranges.groupBy(*keys, "range_no").agg(F.first("part").alias("part"))
    same = F.lit(True)
    asked = _wanted(cuts, keys).withColumnsRenamed({k: f"_w_{k}" for k in [*keys, "range_no"]})
    for k in [*keys, "range_no"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_w_{k}"))
    both = once.join(asked, same).select(*keys, "range_no", "part", "wanted")
    return _joined(both.mapInPandas(_emit(keys, size, lambda row: row["part"]), _bit_schema(ranges, keys)), keys)


def file_pieces(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, size: int = FILE_RANGE) -> DataFrame:
    """(path, piece_no, start, end, forced, piece) of files longer than ``limit`` characters of UTF-8.

    Ranges are read by offset, once for boundaries and once for the pieces; file content is never shuffled
    but for pieces that span ranges. Bytes that are not UTF-8 come out as replacement characters.
    """
    keys = ["path"]
    cuts = cut_table(file_ranges(spark, paths, size), keys, limit, overlap, size)
    wanted = _wanted(cuts, keys)
    bits = wanted.mapInPandas(_emit(keys, size, lambda row: _bytes_at(row["path"], row["range_no"] * size, size + HALO)), _bit_schema(wanted, keys))
    return _joined(bits, keys)
