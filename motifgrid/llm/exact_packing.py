"""Operator 13: best-fit packing by exact-complement hashing.

Documents are encoded once; those longer than a window are cut into windows and a rest. From then on only
lengths matter, and a window has few: the number of pieces of each length is one small table (a row for each length at most),
and from it the driver plans all sequences, as patterns that are used many times each.

The longest length at hand opens a pattern. An index holds, for every sum, how many ordered combinations of one, two and three lengths at hand
give it; it is kept up to date, as a polynomial in the lengths, when a length runs out. While the gap is one of these
sums and the pieces left allow it, a single, pair or triple (the one with the longest first piece) fills it exactly, and the pattern is consumed
as often as the available pieces allow. A gap beyond such sums takes the longest length that fits and is looked up
again. A length whose gap can't be filled goes to the residuals, which are packed best fit, longest first, over the gaps that
they leave themselves; these too are counted, not listed.

Pieces get their place by their rank among those of their length: pieces are range-partitioned by length and a hash, so a
length that a third of all pieces have spreads over partitions, and counts by partition and length
give the ranks. The plan and these counts (at most one for each partition and one for each length) are broadcast; no piece passes through the driver.

Defined results: null and empty texts hold only the end id; rows that repeat, or share a doc_id or have none, are packed as
separate documents; which of two pieces of equal length gets which place is decided by a hash; other columns are left
out; an empty table gives no pieces. Special tokens' strings in a text are ordinary text, as the vocabulary's description reads them.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, pieces, written
from .tokens import word_encoder

WINDOW = 4096


class Sums:
    """How many ordered combinations of one, two and three of the lengths at hand have each sum."""

    def __init__(self, held: np.ndarray):
        self.one = held.astype(np.int64)
        self.two = np.convolve(self.one, self.one)[: len(held)]
        self.three = np.convolve(self.two, self.one)[: len(held)]

    def without(self, x: int) -> None:
        """Takes a length away: (s - x)^3 = s^3 - 3 s^2 x + 3 s x^2 - x^3."""
        n = len(self.one)

        def later(counts, by):
            return np.concatenate([np.zeros(min(by, n), np.int64), counts[: max(0, n - by)]])

        alone = np.zeros(n, np.int64)
        alone[0] = 1
        self.three += 3 * later(self.one, 2 * x) - 3 * later(self.two, x) - later(alone, 3 * x)
        self.two += later(alone, 2 * x) - 2 * later(self.one, x)
        self.one[x] = 0


def complement(gap: int, left: np.ndarray, sums: Sums) -> tuple[int, ...] | None:
    """One, two or three lengths that fill the gap, of which enough are left; longest first."""
    if sums.one[gap] and left[gap]:
        return (gap,)
    if sums.two[gap] and (found := _pair(gap, gap, left)):
        return found
    if sums.three[gap]:
        first = np.arange(-(-gap // 3), gap - 1)
        first = first[(left[first] > 0) & (sums.two[gap - first] > 0)]
        for c in first[::-1].tolist():
            left[c] -= 1
            found = _pair(gap - c, c, left)
            left[c] += 1
            if found:
                return (c, *found)
    return None


def _pair(gap: int, most: int, left: np.ndarray) -> tuple[int, int] | None:
    """Two lengths, none over `most`, that fill the gap."""
    a = np.arange(-(-gap // 2), min(gap - 1, most) + 1)
    a = a[(left[a] > 0) & (left[gap - a] > (2 * a == gap))]
    return (int(a[-1]), gap - int(a[-1])) if len(a) else None


class Plan(NamedTuple):
    """Slots, by length and then by rank: pieces `rank` to `rank` + n - 1 of a length go to sequences from `sequence` on, `each` to a sequence, at `offset` there."""

    length: np.ndarray
    rank: np.ndarray
    n: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        slot = np.searchsorted(self.length * (1 << 48) + self.rank, length * (1 << 48) + rank, side="right") - 1
        nth, each = rank - self.rank[slot], self.each[slot]
        return self.sequence[slot] + nth // each, self.offset[slot] + nth % each * length


def planned(counts: np.ndarray, window: int = WINDOW) -> Plan:
    """The plan for counts[x] pieces of length x, 1 to window."""
    left = np.array(counts, np.int64)
    used, rest, slots, sequences = np.zeros(window + 1, np.int64), np.zeros(window + 1, np.int64), [], 0

    def put(length: int, each: int, sequence: int, bins: int, offset: int, n: int | None = None) -> None:
        n = each * bins if n is None else n
        slots.append((length, int(used[length]), n, each, sequence, offset))
        used[length] += n

    sums = Sums(left > 0)
    for longest in range(window, 0, -1):
        while left[longest]:
            pattern, gap = {longest: 1}, window - longest
            left[longest] -= 1
            while gap:
                if found := complement(gap, left, sums):
                    more = dict.fromkeys(found, 0)
                    for x in found:
                        more[x] += 1
                else:
                    fits = np.flatnonzero(left[: gap + 1])
                    if not len(fits):
                        break
                    x = int(fits[-1])
                    more = {x: min(int(left[x]), max(1, -(-(gap - 3 * x) // x)))}
                for x, n in more.items():
                    pattern[x] = pattern.get(x, 0) + n
                    left[x] -= n
                    gap -= n * x
            for x, n in pattern.items():
                left[x] += n
            if gap:
                rest[longest] += left[longest]
                left[longest] = 0
                sums.without(longest)
                continue
            times, at = min(int(left[x]) // n for x, n in pattern.items()), 0
            for x, n in pattern.items():
                put(x, n, sequences, times, at)
                at += n * x
                left[x] -= n * times
                if not left[x]:
                    sums.without(x)
            sequences += times
    gaps: dict[int, list[tuple[int, int]]] = {}
    for x in np.flatnonzero(rest)[::-1].tolist():
        n = int(rest[x])
        while n:
            gap = min((g for g in gaps if g >= x), default=None)
            if gap is None:
                each = min(window // x, n)
                first, bins, gap = sequences, n // each, window
                sequences += bins
            else:
                first, bins = gaps[gap].pop()
                each = min(gap // x, n)
                if bins > n // each:
                    gaps[gap].append((first + n // each, bins - n // each))
                    bins = n // each
                if not gaps[gap]:
                    del gaps[gap]
            put(x, each, first, bins, window - gap)
            n -= each * bins
            if gap > each * x:
                gaps.setdefault(gap - each * x, []).append((first, bins))
    slots.sort()
    columns = np.array(slots, np.int64).reshape(-1, 6).T
    return Plan(*columns, sequences)


def encoded_pieces(docs: DataFrame, vocabulary: str, end_id: int, window: int, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece, written."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = word_encoder(vocabulary)
        for batch in pieces(batches, "text", 1 << 20):
            out = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]), strict=True):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * window)):
                    part = ids[a : a + 4 * window]
                    out.append((doc, k, a // 4, len(part) // 4, zlib.crc32(part), part)[: len(schema)])
            yield batch_of(schema, **dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)))

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids), "best-fit-pieces")


def ranked(rows: DataFrame) -> DataFrame:
    """The pieces in the order of their lengths, with part and place (from 0 among the pieces of a length in a part), written."""
    spec = ", ".join(f"{k} {t}" for k, t in rows.dtypes) + ", part int, place long"

    def run(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0  # lengths come in runs
        for batch in batches:
            length = batch.column("length").to_numpy()
            if not len(length):
                continue
            first = np.flatnonzero(np.concatenate([[True], length[1:] != length[:-1]]))
            sizes = np.diff([*first, len(length)])
            place = np.arange(len(length)) - np.repeat(first, sizes)
            place[: sizes[0]] += n if length[0] == last else 0
            last, n = length[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(place.astype(np.int64))], names=[*batch.schema.names, "part", "place"])

    keys = ["length", "tie", "doc_id", "piece"]
    mixed = rows.withColumn("tie", F.xxhash64("doc_id", "piece", "ids_crc32"))
    return written(mixed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").mapInArrow(run, spec), "best-fit-ranked")


def packed(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    rows = ranked(encoded_pieces(docs, vocabulary, end_id, window, with_ids))
    # parts are ranges of lengths: a row for each part and each length at most
    found = rows.groupBy("length", "part").agg(F.count("*").alias("n")).orderBy("length", "part").toPandas()
    length, part, n = (found[k].to_numpy().astype(np.int64) for k in ("length", "part", "n"))
    counts = np.zeros(window + 1, np.int64)
    np.add.at(counts, length, n)
    before = np.cumsum(n) - n - (np.cumsum(counts) - counts)[length]
    order = np.lexsort((length, part))
    known = docs.sparkSession.sparkContext.broadcast((planned(counts, window), (part * (window + 1) + length)[order], before[order]))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        plan, keys, starts = known.value
        for batch in batches:
            size, own = batch.column("length").to_numpy().astype(np.int64), batch.column("part").to_numpy().astype(np.int64)
            sequence, offset = plan.places(size, batch.column("place").to_numpy() + starts[np.searchsorted(keys, own * (window + 1) + size)])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in names[:3]], pa.array(size), *[batch.column(k) for k in names[4:]], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids + "sequence_id long, offset long")
