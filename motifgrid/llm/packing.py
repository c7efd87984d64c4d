"""Operator 4: packing by lexical retrieval.

Every document is encoded once into a written table, which also takes a count of documents for each token
id from every task. Documents are then routed to shards by content: a document's route is its ROUTES rarest
token ids among those that at least one document in ROUTED holds, rarest first, and documents are
range-partitioned and sorted by route, so those that share telling ids stand together and no group of equal
routes has to fit a task. A shard is the next SHARD_DOCS documents of that order (or SHARD_TOKENS tokens); it has a
BM25 inverted index over token ids, with the corpus-wide counts; ids that more than COMMON of all
documents hold tell little and are left out. A document that doesn't fill its window is a seed: the
index ranks the shard's unused documents by BM25 for the seed's ids, and the window takes them in that
order. A neighbour that doesn't fit is cut, and its rest is the seed of the next window. A window left
open by the shard goes on in the next one; what is left at the end of a partition is cut into lengths that
are powers of two. So full windows hold no padding, and no sequence needs any.

Defined results: null and empty texts hold only the end id; repeated rows and equal doc_ids are
packed as separate documents; ties in BM25 go to the earlier row of the shard; if no unused document
shares an id with the seed, the next unused one follows; other columns are left out; an empty table
gives no pieces. Memory is bounded by one shard and its index, whatever the keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, buffers, pieces, written
from .tokens import library_encoder

WINDOW, SHARD_DOCS, SHARD_TOKENS = 2048, 1024, 4 << 20
ROUTES, ROUTED, COMMON = 3, 40, 0.5
#: BM25's usual parameters.
K1, B = 1.2, 0.75


def encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, width and ids (binary, little-endian unsigned 16-bit if they fit, else 32-bit), written to the shared folder.

    Each task adds a row without ids, whose `counts` holds its documents, its tokens, and the documents by token id.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        encoder, held, docs_, tokens = library_encoder(vocabulary), np.zeros(1 << 16, np.int64), 0, 0
        for batch in pieces(batches, "text"):
            found, at = encoder.encoded(batch.column("text"))
            n, at = batch.num_rows, at + np.arange(batch.num_rows + 1)
            ids, own = np.full(at[-1], end_id, "<u4"), np.ones(at[-1], bool)
            own[at[1:] - 1] = False
            ids[own] = found
            whole = documents_with(ids, at)
            whole[: len(held)] += held[: len(whole)]
            held = np.concatenate([whole, held[len(whole) :]])
            docs_, tokens = docs_ + n, tokens + len(ids)
            width = np.where(np.maximum.reduceat(ids, at[:-1]) < 65536, 2, 4).astype(np.int32)
            yield batch_of(schema, doc_id=batch.column("doc_id"), width=width, ids=_column(ids, at, width), counts=pa.nulls(n, pa.binary()))
        if docs_:
            yield batch_of(schema, doc_id=[None], width=[0], ids=[None], counts=[np.concatenate([[docs_, tokens], held]).tobytes()])

    return written(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, width int, ids binary, counts binary"), "packing-ids")


def documents_with(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of documents that hold each token id; document i is ids[at[i] : at[i + 1]]."""
    size = int(ids.max()) + 1
    kind = np.uint32 if size * len(at) < 1 << 32 else np.int64
    keys = np.repeat(np.arange(len(at) - 1, dtype=kind) * kind(size), np.diff(at)) + ids.astype(kind)
    keys.sort()
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.bincount(keys[first] % kind(size), minlength=size)


def _column(ids: np.ndarray, at: np.ndarray, width: np.ndarray) -> pa.Array:
    """Documents as a binary column, each in its width."""
    if (width == width[0]).all():
        return pa.Array.from_buffers(pa.binary(), len(width), [None, pa.py_buffer((at * width[0]).astype(np.int32)), pa.py_buffer(ids.astype(f"<u{width[0]}"))])
    return pa.array([ids[a:b].astype(f"<u{w}").tobytes() for a, b, w in zip(at[:-1], at[1:], width, strict=True)], pa.binary())


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents one after another, and where each document's start (n + 1 places)."""
    held, at = buffers(batch.column("ids"))
    width = batch.column("width").to_numpy()
    if (width == width[0]).all():
        return held.view(f"<u{width[0]}").astype(np.int64), at // width[0]
    return np.concatenate([held[a:b].view(f"<u{w}").astype(np.int64) for a, b, w in zip(at[:-1], at[1:], width, strict=True)]), np.concatenate([[0], np.cumsum(np.diff(at) // width)])


def document_counts(rows: DataFrame) -> tuple[np.ndarray, int, float]:
    """Number of documents that hold each token id, the number of documents, the mean length."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        whole = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                x = np.frombuffer(x.as_buffer(), np.int64)
                whole = x + np.pad(whole, (0, len(x) - len(whole))) if len(x) >= len(whole) else whole + np.pad(x, (0, len(whole) - len(x)))
        found = np.flatnonzero(whole)
        if len(found):
            yield batch_of(schema, id=found, n=whole[found])

    # one row for each entry of the vocabulary at most, whatever the number of documents
    counts = rows.filter("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    whole = np.zeros(int(counts["id"].max()) + 2 if len(counts) else 3, np.int64)
    whole[counts["id"]] = counts["n"]
    return whole[2:], int(whole[0]), float(whole[1] / max(whole[0], 1))


def routed(rows: DataFrame, counts) -> DataFrame:
    """The documents in the order of their routes: the ROUTES rarest ids that one document in ROUTED holds."""
    names = [f"r{i}" for i in range(ROUTES)]
    schema = pa.schema([("doc_id", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), *[(k, pa.int64()) for k in names], ("tie", pa.int64())])

    def run(batches):
        held, n = counts.value
        telling = np.flatnonzero(held * ROUTED >= n)
        telling = telling[np.argsort(held[telling], kind="stable")]  # rarest first, then by id
        place = np.full(len(held), len(telling), np.int32)
        place[telling] = np.arange(len(telling))
        rank = np.append(held[telling] * len(held) + telling, (n + 1) * len(held))
        for batch in pieces(batches, "ids"):
            ids, at = _ids(batch)
            left, routes = place[ids], []
            for _ in names:
                least = np.minimum.reduceat(left, at[:-1])
                routes.append(rank[least])
                left[left == np.repeat(least, np.diff(at))] = len(telling)
            yield batch_of(schema, doc_id=batch.column("doc_id"), width=batch.column("width"), ids=batch.column("ids"), tie=[zlib.crc32(x.as_buffer()) for x in batch.column("ids")], **dict(zip(names, routes, strict=True)))

    keyed = rows.filter("ids is not null").select("doc_id", "width", "ids").mapInArrow(run, "doc_id long, width int, ids binary, " + ", ".join(f"{k} long" for k in names) + ", tie long")
    return keyed.repartitionByRange(*names, "tie", "doc_id").sortWithinPartitions(*names, "tie", "doc_id").select("doc_id", "width", "ids")


class Bm25:
    """Inverted index over the token ids of a shard; ids without an idf are left out."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.size = len(docs)
        found = []
        for ids in docs:
            term, n = np.unique(ids, return_counts=True)
            telling = idf[term] > 0
            found.append((term[telling], n[telling]))
        self.terms = [x for x, _ in found]
        doc = np.repeat(np.arange(self.size), [len(x) for x, _ in found])
        term, tf = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        norm = K1 * (1 - B + B * np.array([len(x) for x in docs]) / max(mean, 1))
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.weight, self.idf = doc[order], weight[order], idf
        self.start = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def rank(self, seed: int, free: np.ndarray) -> np.ndarray:
        """The free documents, best first."""
        left, terms = np.flatnonzero(free), self.terms[seed]
        if not len(terms):
            return left
        a, n = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.arange(n.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        scores = np.bincount(self.doc[at], weights=self.weight[at], minlength=self.size)
        return left[np.argsort(-scores[left], kind="stable")]


class Windows:
    """Pieces of the open window and of closed ones."""

    def __init__(self, first: int, window: int):
        self.sequence, self.used, self.window, self.closed, self.open = first, 0, window, [], []

    def add(self, doc, ids: np.ndarray, start: int, whole: int) -> int:
        """Puts in what fits from `start` on; gives the new start."""
        n = min(self.window - self.used, len(ids) - start)
        self.open.append((doc, start, ids[start : start + n], whole, self.used))
        self.used += n
        if self.used == self.window:
            self.close()
        return start + n

    def close(self) -> None:
        self.closed += [(doc, start, len(x), zlib.crc32(x.astype("<u4").tobytes()), whole, self.sequence, at, x) for doc, start, x, whole, at in self.open]
        self.sequence, self.used, self.open = self.sequence + 1, 0, []

    def end(self) -> None:
        """Cuts the open window into sequences whose lengths are powers of two."""
        left, total, window = self.open[::-1], self.used, self.window
        self.used, self.open = 0, []
        while total:
            self.window = 1 << (total.bit_length() - 1)
            total -= self.window
            room = self.window
            while room:
                doc, start, x, whole, _ = left.pop()
                n = min(room, len(x))
                room -= n
                self.open.append((doc, start, x[:n], whole, self.used))
                self.used += n
                if n < len(x):
                    left.append((doc, start + n, x[n:], whole, 0))
            self.close()
        self.window = window


def packed_shard(docs: list[tuple[object, np.ndarray]], idf: np.ndarray, mean: float, out: Windows) -> None:
    """Packs a shard; the window that stays open goes on with the next shard."""
    index, free, start = Bm25([x for _, x in docs], idf, mean), np.ones(len(docs), bool), [0] * len(docs)
    ranking: Iterator[int] = iter(())
    fresh = True
    for _ in range(len(docs)):
        doc = next((i for i in ranking if free[i]), None)
        if doc is None:
            doc = int(np.argmax(free))
        free[doc] = False
        name, ids = docs[doc]
        before = out.sequence
        while start[doc] < len(ids):
            start[doc] = out.add(name, ids, start[doc], len(ids))
        fresh = fresh or out.sequence != before
        if fresh and free.any():  # the window's first document is its seed
            ranking, fresh = iter(index.rank(doc, free)), out.used == 0


def packed(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW, shard_docs: int = SHARD_DOCS, with_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    rows, context = encoded(docs, vocabulary, end_id), docs.sparkSession.sparkContext
    counts, n, mean = document_counts(rows)
    idf = np.where(counts <= COMMON * n, np.log1p((n - counts + 0.5) / (counts + 0.5)), 0)
    held, known = context.broadcast(idf), context.broadcast((counts, n))  # 8 bytes for each vocabulary entry
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = pa.schema([(k, pa.int64()) for k in names] + [("ids", pa.binary())] * with_ids)

    def run(batches):
        out, shard, size = Windows(TaskContext.get().partitionId() << 40, window), [], 0

        def done():
            columns = dict(zip(names, map(list, zip(*(x[:7] for x in out.closed), strict=True)), strict=True)) if out.closed else None
            if columns and with_ids:
                columns["ids"] = [x[7].astype("<u4").tobytes() for x in out.closed]
            out.closed = []
            return [batch_of(schema, **columns)] if columns else []

        for batch in pieces(batches, "ids"):
            flat, at = _ids(batch)
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids = flat[a:b]
                shard.append((doc, ids))
                size += len(ids)
                if len(shard) == shard_docs or size >= SHARD_TOKENS:
                    packed_shard(shard, held.value, mean, out)
                    shard, size = [], 0
                    yield from done()
        if shard:
            packed_shard(shard, held.value, mean, out)
        out.end()
        yield from done()

    return routed(rows, known).mapInArrow(run, ", ".join(f"{k} long" for k in names) + ", ids binary" * with_ids)
