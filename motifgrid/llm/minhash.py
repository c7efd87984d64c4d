"""Operator 7: near-duplicates by one-permutation MinHash with optimal densification.

A text's 5-word shingles are hashed once. The hash range is cut into BANDS * ROWS bins, a bin's
value is its least hash, and an empty bin takes the value of the first full bin in an order of its own
(the same order for every text). Bins are grouped into bands; texts that agree on a band
share its bucket. Texts with equal sets are first merged into one class, so that copies cost nothing.

Candidates are stars: the centre of a bucket is its smallest doc_id, and every text is paired with the
smallest centre of its buckets, so there are fewer pairs than texts. A star's pairs are checked on the full
shingle sets, its centre copied once for each STAR members, and merged into components.

Buckets that still span several components are then settled exactly. The members of the bucket's largest
component and the outsiders are dealt into blocks; a cell is a pair of blocks that holds an outsider
block, and one task compares all pairs of a cell across components inside its memory. No pair leaves a cell
but the edges of a forest over its components, fewer than members. Two bounds that lose no pair come
first: the sizes of the sets, and their parities. A parity has a bit for each slot of the hash range modulo its
length, set if an odd number of shingles fall there, so two texts differ in as many shingles
at least as their parities differ in bits. A first pass takes its forest from the bounds alone and checks
the edges on full sets; a second one ships the full sets of the members that still have a possible partner in
another component, and takes its forest from links that hold. So every link inside a bucket counts,
whatever the bucket's size.

Components come from repeated contraction of the checked links in written tables; nothing is collected
to the driver, and tables that no later step reads are removed.

Defined results: words are maximal runs outside ASCII white space, with A-Z lower-cased; a text of
fewer than five words has one shingle; null texts and texts without words have none, link with
nothing and are kept. A null doc_id takes the component of its equal texts, else null, and is kept
only then; it isn't linked to other texts. Rows that repeat a doc_id are answered one by one; texts with the same smallest
doc_id count as one document. Other columns are left out; an empty table gives no rows.

At a similarity of s a pair shares no bucket with probability (1 - s^6)^40: 0.0004 at 0.75, 7e-6 at
0.8. No pair that shares a bucket is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bucketed, buffers, pieces, removed, written
from .shingles import U, constants, mix, set_key, shingle_sets

WORDS, PERCENT = 5, 75
BANDS, ROWS = 40, 6
#: Members of a star that share a copy of its centre; bytes of a block of a cell.
STAR, BLOCK_BYTES = 64, 8 << 20
_BINS = BANDS * ROWS
#: Row i is the order in which bin i, if empty, looks for a full one.
_ORDER = np.argsort(constants(_BINS * _BINS, 5).reshape(_BINS, _BINS), axis=1)
_ROW, _BAND = constants(ROWS, 6), constants(BANDS, 7)


def signature(held: np.ndarray) -> np.ndarray:
    """The bins of a sorted set of hashes that isn't empty."""
    bins = ((held >> U(32)) * U(_BINS)) >> U(32)
    first = np.concatenate([[True], bins[1:] != bins[:-1]])
    full, out = np.zeros(_BINS, bool), np.zeros(_BINS, np.uint64)
    at = bins[first].astype(np.int64)
    full[at], out[at] = True, held[first]
    empty = np.flatnonzero(~full)
    for a, b in ((0, 16), (16, _BINS)):
        if len(empty):
            hit = full[_ORDER[empty, a:b]]
            found = hit.any(axis=1)
            done = empty[found]
            out[done] = out[_ORDER[done, a + hit[found].argmax(axis=1)]]
            empty = empty[~found]
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    rows = signatures.reshape(len(signatures), BANDS, ROWS)
    return mix((rows * _ROW).sum(axis=2, dtype=np.uint64) + _BAND)


def parity(held: np.ndarray) -> bytes:
    """The parities of a set of hashes, in the least power of two of bits that is four times its size or more (512 at least)."""
    bits = 1 << max(9, (4 * len(held) - 1).bit_length())
    return np.packbits(np.bincount((held & U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").astype(np.uint8).tobytes()


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are alike enough."""
    few, many = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(few) < PERCENT * len(many):
        return False
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    both = int((many[at] == few).sum())
    return both > 0 and 100 * both >= PERCENT * (len(few) + len(many) - both)


class Members:
    """Members of a block, by the size of their sets; parities of equal length stand together."""

    def __init__(self, doc, n, label, parities: list[bytes], held: list[bytes] | None = None):
        order = np.argsort(n, kind="stable")
        self.doc, self.n, self.label = doc[order], n[order], label[order]
        self.held = [np.frombuffer(held[i], np.uint64) for i in order.tolist()] if held else None
        parities = [parities[i] for i in order.tolist()]
        self.width = np.array([len(x) for x in parities], np.int64) // 8
        self.runs = {}
        for w in np.unique(self.width).tolist():
            a, b = np.searchsorted(self.width, [w, w + 1]).tolist()
            self.runs[w] = a, b, np.frombuffer(b"".join(parities[a:b]), np.uint64).reshape(-1, w)
        self.folds: dict[int, np.ndarray] = {}

    def row(self, i: int) -> np.ndarray:
        a, _, rows = self.runs[int(self.width[i])]
        return rows[i - a]

    def folded(self, w: int) -> np.ndarray:
        """The parities of length w, folded to half of it."""
        if w not in self.folds:
            self.folds[w] = np.bitwise_xor.reduce(self.runs[w][2].reshape(-1, 2, w // 2), axis=1)
        return self.folds[w]


def possible(a: Members, b: Members, triangle: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of a, the rows of b of other labels that sizes and parities don't exclude, and their differing bits.

    triangle: a is b, and each pair comes once.
    """
    low, high = np.searchsorted(b.n, -(-PERCENT * a.n // 100)), np.searchsorted(b.n, 100 * a.n // PERCENT, side="right")
    for i, (lo, hi) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        lo = max(lo, i + 1) if triangle else lo
        if lo >= hi:
            continue
        w, own = int(a.width[i]), a.row(i)
        for v in (w // 2, w, 2 * w):
            if v not in b.runs:
                continue
            first, last, rows = b.runs[v]
            s, e = max(lo, first), min(hi, last)
            if s >= e:
                continue
            if v == w:
                apart = np.bitwise_count(rows[s - first : e - first] ^ own)
            elif v > w:
                apart = np.bitwise_count(b.folded(v)[s - first : e - first] ^ own)
            else:
                apart = np.bitwise_count(rows[s - first : e - first] ^ np.bitwise_xor.reduce(own.reshape(2, -1), axis=0))
            apart = apart.sum(axis=1, dtype=np.int64)
            size = b.n[s:e] + a.n[i]
            both = (size - apart) // 2  # at most
            js = np.flatnonzero((100 * both >= PERCENT * (size - both)) & (b.label[s:e] != a.label[i]))
            if len(js):
                yield i, js + s, apart[js]


def forest(a: Members, b: Members, triangle: bool) -> Iterator[tuple[int, int]]:
    """Edges (doc_ids) that join the labels of possible pairs, checked on full sets where a has them."""
    root: dict[int, int] = {}

    def find(x):
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    for i, js, apart in possible(a, b, triangle):
        mine = int(a.label[i])
        js = js[np.argsort(apart, kind="stable")]
        if not a.held:  # the nearest row of each label
            js = js[np.sort(np.unique(b.label[js], return_index=True)[1])]
        for j, other in zip(js.tolist(), b.label[js].tolist(), strict=True):
            x, y = find(mine), find(other)
            if x != y and (not a.held or alike(a.held[i], b.held[j])):
                root[max(x, y)] = min(x, y)
                yield int(a.doc[i]), int(b.doc[j])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), k1 and k2 (128-bit key of the set), and its bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in pieces(batches, "text", 1 << 19):
            sets = shingle_sets(*buffers(batch.column("text")), WORDS)
            keys = [set_key(x) for x in sets]
            rows = [i for i, x in enumerate(sets) if len(x)]
            bands = band_keys(np.stack([signature(sets[i]) for i in rows])).view(np.int64) if rows else np.empty(0, np.int64)
            at = np.zeros(len(sets) + 1, np.int32)
            at[1:] = np.cumsum([BANDS if len(x) else 0 for x in sets])
            yield batch_of(schema, doc_id=batch.column("doc_id"), n=[len(x) for x in sets], k1=[a for a, _ in keys], k2=[b for _, b in keys], bands=pa.ListArray.from_arrays(pa.array(at), pa.array(bands.ravel())))

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, n long, k1 long, k2 long, bands array<long>")


def shared_buckets(heads: DataFrame) -> DataFrame:
    """doc_id and key of the buckets that hold two texts or more."""
    rows = heads.select("doc_id", F.explode("bands").alias("key"))
    keys = written(rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"), "minhash-keys")
    shared = written(rows.join(keys, "key", "left_semi").select("doc_id", "key"), "minhash-buckets")
    removed(keys)
    return shared


def full_sets(docs: DataFrame, heads: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, n, parity and held (the whole set) of the texts that share a bucket, bucketed by doc_id; each text is shuffled and shingled once."""
    named = written(shared.select("doc_id").distinct(), "minhash-named")
    mine = heads.select("doc_id", "k1", "k2").join(named, "doc_id", "left_semi")
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("parity", pa.binary()), ("held", pa.binary())])

    def run(batches):
        for batch in pieces(batches, "text", 1 << 19):
            sets, keys = shingle_sets(*buffers(batch.column("text")), WORDS), zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)
            same = [set_key(x) == k for x, k in zip(sets, keys, strict=True)]  # a row may repeat a doc_id with another text
            sets = [x for x, k in zip(sets, same, strict=True) if k]
            yield batch_of(schema, doc_id=batch.column("doc_id").filter(pa.array(same, pa.bool_())), n=[len(x) for x in sets], parity=[parity(x) for x in sets], held=[x.tobytes() for x in sets])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    # the texts grow with the corpus, as do those that are named: the same join at every size
    rows = rows.join(mine.hint("merge"), "doc_id").mapInArrow(run, "doc_id long, n long, parity binary, held binary")
    sets = bucketed(rows, "minhash-sets", "doc_id", "none")
    removed(named)
    return sets


def stars(shared: DataFrame) -> DataFrame:
    """Pairs (a, b): every text b with the smallest centre of its buckets, if that isn't b."""
    centres = shared.groupBy("key").agg(F.min("doc_id").alias("a"))
    return shared.join(centres, "key").filter("a <> doc_id").groupBy(F.col("doc_id").alias("b")).agg(F.min("a").alias("a")).select("a", "b")


def checked(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough; many pairs may share an a, whose set is copied once for STAR of them."""
    pairs = written(pairs, "minhash-pairs")
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    members = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("doc_id"))
    centres = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("doc_id"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        star, centre = None, []
        for batch in batches:
            found = []
            columns = (batch.column(k).to_pylist() for k in ("a", "salt", "role", "doc_id"))
            for a, salt, role, b, held in zip(*columns, batch.column("held"), strict=True):
                if (a, salt) != star:
                    star, centre = (a, salt), []
                held = np.frombuffer(held.as_buffer(), np.uint64)
                if role == 0:
                    centre.append(held.copy())
                elif any(alike(x, held) for x in centre):
                    found.append((a, b))
            yield batch_of(out, a=[a for a, _ in found], b=[b for _, b in found])

    rows = members.unionByName(centres).join(sets.select("doc_id", "held"), "doc_id").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    links = written(rows.select("a", "salt", "role", "doc_id", "held").mapInArrow(run, "a long, b long"), "minhash-links")
    removed(pairs)
    return links


def open_rows(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows (doc_id, key) of buckets that span several components, with label, whether the row is outside the largest one, and the sizes of both parts."""
    if labels is not None:
        shared = shared.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").select("doc_id", "key", F.coalesce("label", "doc_id").alias("label"))
    parts = shared.groupBy("key", "label").agg(F.count("*").alias("m"))
    spans = parts.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("m", "label")).alias("most"), F.sum("m").alias("members")).filter("labels > 1")
    spans = spans.select("key", F.col("most.label").alias("largest"), F.col("most.m").alias("inside"), (F.col("members") - F.col("most.m")).alias("outside"))
    return shared.join(spans, "key").select("doc_id", "key", "label", (F.col("label") != F.col("largest")).alias("outsider"), "inside", "outside")


def cells(rows: DataFrame, sets: DataFrame, size: str) -> DataFrame:
    """The open rows dealt to cells (key, x, y), with the columns of sets; `size` names the largest of these.

    y >= 0: blocks x and y of outsiders; y < 0: block x of outsiders and block -1 - y of the largest component; x = y = -1:
    all members, where one block of each is enough. The number of blocks of outsiders grows with the
    square root of theirs, so neither cells nor copies grow fast.
    """
    rows = rows.join(sets, "doc_id")
    bytes_ = F.octet_length(size).cast("double")
    weights = rows.groupBy("key").agg(F.sum(F.when(F.col("outsider"), bytes_)).alias("b_out"), F.sum(F.when(~F.col("outsider"), bytes_)).alias("b_in"))
    weights = weights.select("key", F.greatest(F.ceil(F.coalesce("b_out", F.lit(0.0)) / BLOCK_BYTES), F.lit(1)).alias("w_out"), F.greatest(F.ceil(F.coalesce("b_in", F.lit(0.0)) / BLOCK_BYTES), F.lit(1)).alias("w_in"))
    rows = rows.join(weights, "key")
    n_out = F.greatest(F.ceil(F.sqrt("outside") / 32), F.col("w_out")).cast("int")
    n_in = F.greatest(F.ceil(F.col("inside") / 1024), F.col("w_in")).cast("int")
    block = F.pmod(F.xxhash64("doc_id"), F.when(F.col("outsider"), n_out).otherwise(n_in)).cast("int")
    rows = rows.withColumns({"n_out": n_out, "n_in": n_in}).withColumn("block", block)
    cell = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    to_out = F.when(F.col("outside") > 1, F.transform(F.sequence(F.lit(0), F.col("n_out") - 1), lambda j: cell(F.least(j, F.col("block")), F.greatest(j, F.col("block")))))
    to_in = F.transform(F.sequence(F.lit(0), F.col("n_in") - 1), lambda j: cell(F.col("block"), -1 - j))
    from_in = F.transform(F.sequence(F.lit(0), F.col("n_out") - 1), lambda j: cell(j, -1 - F.col("block")))
    none = F.array().cast("array<struct<x:int,y:int>>")
    of = F.when(F.col("outsider"), F.concat(F.coalesce(to_out, none), to_in)).otherwise(from_in)
    of = F.when((F.col("n_out") == 1) & (F.col("n_in") == 1), F.array(cell(F.lit(-1), F.lit(-1)))).otherwise(of)
    rows = rows.withColumn("cell", F.explode(of)).select("key", "cell.x", "cell.y", "doc_id", "label", "outsider", "block", *[c for c in sets.columns if c != "doc_id"])
    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Members, Members, bool]]:
    """key, two blocks, and whether they are one, for cells that come in runs."""
    pending: list[pa.RecordBatch] = []

    def cell():
        rows = pa.Table.from_batches(pending)
        key, x, y = (rows.column(k)[0].as_py() for k in ("key", "x", "y"))
        doc, n, label, block = (rows.column(k).to_numpy() for k in ("doc_id", "n", "label", "block"))
        outsider = rows.column("outsider").to_numpy()
        parities, held = rows.column("parity").to_pylist(), rows.column("held").to_pylist() if "held" in rows.column_names else None

        def members(which):
            at = np.flatnonzero(which)
            return Members(doc[at], n[at], label[at], [parities[i] for i in at.tolist()], [held[i] for i in at.tolist()] if held else None)

        if y >= 0:
            one = members(block == x)
            return [(key, one, one, True) if x == y else (key, one, members(block == y), False)]
        one, more = members(outsider), int(x == -1 and outsider.sum() > 1)
        return [(key, one, members(~outsider), False)] + [(key, one, one, True)] * more

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        of = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("key", "x", "y")])
        cuts = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            this = tuple(of[:, a].tolist())
            if this != last and pending:
                if sum(x.num_rows for x in pending) > 1:
                    yield from cell()
                pending.clear()
            last = this
            pending.append(batch.slice(a, b - a))
    if sum(x.num_rows for x in pending) > 1:
        yield from cell()


def forests(rows: DataFrame) -> DataFrame:
    """Edges (a, b) of the cells' forests."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for _, a, b, triangle in _blocks(batches):
            if found := list(forest(a, b, triangle)):
                yield batch_of(out, a=[min(x) for x in found], b=[max(x) for x in found])

    return rows.mapInArrow(run, "a long, b long").distinct()


def undecided(rows: DataFrame) -> DataFrame:
    """The members (key, doc_id) of cells that have a possible partner in another component."""
    out = pa.schema([("key", pa.int64()), ("doc_id", pa.int64())])

    def run(batches):
        for key, a, b, triangle in _blocks(batches):
            found: set[int] = set()
            for i, js, _ in possible(a, b, triangle):
                found.add(int(a.doc[i]))
                found.update(b.doc[js].tolist())
            if found:
                yield batch_of(out, key=[key] * len(found), doc_id=list(found))

    return rows.mapInArrow(run, "key long, doc_id long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label (smallest node of its component) for the nodes of the links (a, b).

    Every node is contracted into the smallest of itself and its neighbours until no link is left,
    which at least halves the nodes each time. Links and maps are written tables.
    """
    maps, old = [], None
    links = links.distinct()
    while True:
        both = links.select(F.explode(F.expr("array(struct(a as node, b as other), struct(b as node, a as other))")).alias("x")).select("x.*")
        step = written(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")), "minhash-step")
        maps.append(step)
        links = links.join(step.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        links = written(links.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "minhash-contracted")
        if old is not None:
            removed(old)
        old = links
        if links.isEmpty():
            break
    labels = maps[0]
    for step in maps[1:]:
        labels = labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    labels = written(labels, "minhash-labels")
    removed(old, *maps)
    return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels with further links (a, b)."""
    if links.isEmpty():
        return labels
    new = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).filter("a <> b").unionByName(links))
    removed(labels, links)
    return new


def settled(shared: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels with every link between texts that share a bucket."""
    rows = written(open_rows(shared, labels), "minhash-open")
    if rows.isEmpty():
        return labels
    short = sets.select("doc_id", "n", "parity")
    labels = merged(labels, checked(sets, forests(cells(rows, short, "parity"))))
    still = written(open_rows(rows.select("doc_id", "key"), labels), "minhash-still-open")
    removed(rows)
    members = written(undecided(cells(still, short, "parity")), "minhash-undecided")
    if not members.isEmpty():
        rows = open_rows(still.join(members, ["key", "doc_id"], "left_semi").select("doc_id", "key", "label"), None)
        labels = merged(labels, written(forests(cells(rows, sets, "held")), "minhash-links"))
    removed(still, members)
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    rows = written(sketches(docs), "minhash-sketches")
    copies = rows.filter("n > 0").groupBy("k1", "k2").agg(F.count("*").alias("m"), F.min("doc_id").alias("first"))
    copies = written(copies.filter("m > 1").select("k1", "k2", "first", F.lit(True).alias("copied")), "minhash-copies")
    heads = rows.filter("n > 0 and doc_id is not null").join(copies, ["k1", "k2"], "left").filter("copied is null or doc_id = first").select("doc_id", "k1", "k2", "bands")
    shared = shared_buckets(heads)
    sets = full_sets(docs, heads, shared)
    labels = settled(shared, sets, components(checked(sets, stars(shared))))
    removed(shared, sets)
    out = rows.select("doc_id", "n", "k1", "k2").join(copies, ["k1", "k2"], "left").withColumn("node", F.when((F.col("n") > 0) & F.col("copied"), F.col("first")).otherwise(F.col("doc_id")))
    out = out.join(labels, "node", "left")
    component = F.coalesce("label", "node")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
