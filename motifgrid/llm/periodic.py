"""Operator 11: periodic runs of words, by probing a harmonic grid.

A run of period p and length max(SHORTEST, EXPONENT * p) or more holds EXPONENT neighbouring multiples of p, so for each
p the words at jp and (j+1)p are compared, for all j at once, and only places where EXPONENT - 1 such comparisons in a row hold
survive: n ln n comparisons for n words, whatever the text. A survivor is extended to both sides by comparing slices
that double in size. Grid points of the same period inside the stretch are skipped, as are those whose pair of
words lies in a run found before whose period divides p: the stretch around them is that run again.
Since periods grow, each run is found at its smallest period and only there.

Words are compared by numbers that a dictionary of the document gives, so equal numbers mean equal words. A
document is one unit of work; nothing is shuffled or collected.

Defined results: words are maximal runs outside ASCII white space; a null or empty text has no words, no runs and an
empty collapsed text; repeated rows and equal doc_ids are answered one by one, a null doc_id too; of equally strong runs the first, then the one of
smaller period, is the strongest; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, pieces

SHORTEST, EXPONENT = 6, 4
#: Texts of fewer words share one table of grid points, about 8 a word; those of longer ones are made by period.
GRID_WORDS = 1 << 14

Run = tuple[int, int, int]


@functools.cache
def _grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid points, their periods and the last place that they probe, by that place: a text uses the first ones."""
    found = [np.arange(0, GRID_WORDS - (EXPONENT - 1) * p, p) for p in range(1, GRID_WORDS // EXPONENT + 1)]
    point, period = np.concatenate(found), np.repeat(np.arange(1, len(found) + 1), [len(x) for x in found])
    last = point + (EXPONENT - 1) * period
    order = np.argsort(last, kind="stable")
    return point[order], period[order], last[order]


def survivors(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each period with grid points from which EXPONENT words a period apart are equal, and these, both ascending."""
    n = len(words)
    if n > GRID_WORDS:
        for p in range(1, n // EXPONENT + 1):
            held = words[::p]
            same = held[1:] == held[:-1]
            at = same[: len(same) - EXPONENT + 2].copy()
            for j in range(1, EXPONENT - 1):
                at &= same[j : len(at) + j]
            if at.any():
                yield p, np.flatnonzero(at) * p
        return
    point, period, last = _grid()
    point, period = (x[: np.searchsorted(last, n)] for x in (point, period))
    for _ in range(EXPONENT - 1):
        same = words[point] == words[point + period]
        point, period = point[same] + period[same], period[same]
    point -= (EXPONENT - 1) * period
    order = np.lexsort((point, period))
    point, period = point[order], period[order]
    cuts = np.flatnonzero(np.diff(period)) + 1
    for a in np.split(np.arange(len(point)), cuts) if len(point) else ():
        yield int(period[a[0]]), point[a]


def stretch(words: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The places around `at` whose words equal those p later: first, and one past the last."""
    n = len(words) - p
    stop, step = at, 64
    while stop < n:
        differ = words[stop : min(n, stop + step)] != words[stop + p : min(n, stop + step) + p]
        if differ.any():
            stop += int(differ.argmax())
            break
        stop, step = stop + len(differ), 2 * step
    start, step = at, 64
    while start > 0:
        a = max(0, start - step)
        differ = (words[a:start] != words[a + p : start + p])[::-1]
        if differ.any():
            start -= int(differ.argmax())
            break
        start, step = a, 2 * step
    return start, stop


def runs(words: np.ndarray) -> list[Run]:
    """(start, length, period) of every run of a sequence of numbers, by start, then period."""
    found: dict[int, tuple[list[int], list[int]]] = {}
    for p, points in survivors(words):
        for q, (starts, stops) in found.items():
            if p % q == 0 and len(points):
                at = np.searchsorted(starts, points, side="right") - 1
                points = points[(at < 0) | (points + p >= np.array(stops)[at])]
        end = 0
        for point in points.tolist():
            if point < end:
                continue
            start, end = stretch(words, point, p)
            if end - start + p >= max(SHORTEST, EXPONENT * p):
                starts, stops = found.setdefault(p, ([], []))
                starts.append(start)
                stops.append(end + p)
    return sorted((a, b - a, p) for p, (starts, stops) in found.items() for a, b in zip(starts, stops, strict=True))


def strongest(found: list[Run]) -> Run | None:
    """The run of the greatest length / period, compared as whole numbers."""
    best = None
    for x in found:
        if best is None or x[1] * best[2] > best[1] * x[2]:
            best = x
    return best


def kept_words(n: int, found: list[Run]) -> np.ndarray:
    """Which of n words stay: a run keeps its first period."""
    cover = np.zeros(n + 1, np.int64)
    for start, length, p in found:
        cover[start + p] += 1
        cover[start + length] -= 1
    return np.cumsum(cover[:-1]) == 0


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", rewritten: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (start, length, period), strongest (one of them, or null) and collapsed: the words that no run repeats, joined by a space.

    rewritten: gives the words to search in place of a document's own.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(run_type)), ("strongest", run_type), ("collapsed", pa.string())])
    named = lambda x: x and dict(zip(("start", "length", "period"), x, strict=True))

    def of(doc, held: bytes):
        words = held.split()  # ASCII white space, as bytes have no other
        if rewritten:
            words = rewritten(doc, words)
        number = dict(zip(words, range(len(words)), strict=True))
        found = runs(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        left = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()] if found else words
        return found, b" ".join(left)

    def run(batches):
        for batch in pieces(batches, "text", 1 << 20):
            ids = batch.column("doc_id").to_pylist()
            made = [of(doc, held or b"") for doc, held in zip(ids, batch.column("text").cast(pa.binary()).to_pylist(), strict=True)]
            yield batch_of(schema, doc_id=batch.column("doc_id"), runs=[[named(x) for x in found] for found, _ in made], strongest=[named(strongest(found)) for found, _ in made], collapsed=pa.array([x for _, x in made], pa.binary()).cast(pa.string()))

    kind = "struct<start:bigint,length:bigint,period:bigint>"
    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, f"doc_id long, runs array<{kind}>, strongest {kind}, collapsed string")


def with_repeats(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The words, those of one document in ten repeated with a period from some place on; doc_id decides."""
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * -(-(n - a) // p))[: n - a]


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, and digests of the runs and of the collapsed text."""
    best = F.col("strongest")
    line = lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda x: F.concat(line(x), F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
