"""Near-duplicate detection with an LSH forest.

Rows with the same set of word shingles form a class. Every class has a MinHash
signature, cut into TREES orders of DEPTH values each. All classes are sorted by
every order; in a sorted order, neighbours are those with the longest common
prefix. A region (a run that shares a prefix) of more than REGION classes is
taken one value deeper, and so on, so that depth adapts to how crowded a place
is; at full depth all of a region are candidates of each other. In a smaller
region those whose sketches agree enough are. Candidates are joined to clusters,
and within a cluster links are confirmed on full sets of shingles.

Sorted orders are dealt to tasks by ranges, and a region that lies across a
border is looked at in two parts; its pairs across the border are left to the
other orders, whose borders are elsewhere. Nothing is capped. A cluster of more than CHUNK classes is dealt to chunks that
are confirmed side by side, each together with the cluster's few pivots, which
joins nearly all of a dense cluster at once; what is still outside the
cluster's largest component then meets every member of the cluster, chunk by
chunk. Pairs are never emitted, only the links of a spanning forest.

Shingles are known by 64-bit hashes and sets by two such numbers and their size.
A very long text is one set, measured whole in one task; a link at exactly the
limit counts; ties in an order go by class. Texts without a word have an empty
set and link with nothing, as has null text. A null doc_id takes part; a component's id is its smallest doc_id that isn't
null. Repeated rows have the same set and so one component. An empty table gives
an empty result; other columns are ignored by :func:`query` and kept by
:func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import Texts, chunks, mix, pair
from ._graph import components
from ._store import delete, discard, materialise, numbered, scope, small_side, without

#: Percent of the union that two sets must share.
PERCENT = 80
TREES, DEPTH, SKETCH = 16, 8, 64
#: Bytes of two sketches that must agree: five standard deviations below what sets at 80 percent have.
AGREE = 35
REGION, CHUNK, PIVOTS = 256, 96, 32
#: A set of fewer shingles has no near neighbour but its equals: n / (n + 1) is below PERCENT.
LEAST = -(-PERCENT // (100 - PERCENT))
#: Sorted rows that one task takes.
TASK_ROWS = 100_000

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(t: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct k-word shingles, in order; a text of fewer words is one shingle."""
    ws, we = t.words()
    owner, h = t.owner(ws), t.hashes(ws, we)
    n = np.bincount(owner, minlength=t.n)
    acc, own = h, owner
    if k > 1:
        size = max(0, len(h) - k + 1)
        acc, own = h[:size], owner[:size]
        for j in range(1, k):
            acc = pair(acc, h[j : j + size])
        inside = own == owner[k - 1 : k - 1 + size]
        acc, own = acc[inside], own[inside]
        first = np.cumsum(n) - n
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            at = np.concatenate([np.arange(first[s], first[s] + n[s]) for s in short])
            starts = np.cumsum(n[short]) - n[short]
            place = (at - first[owner[at]]).astype(np.uint64)
            one = mix(np.add.reduceat(mix(h[at] + place), starts) + np.uint64(7))
            acc, own = np.append(acc, one), np.append(own, short)
    order = np.lexsort((acc, own))
    acc, own = acc[order], own[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (own[1:] != own[:-1])
    return own[new], acc[new]


def signatures(own: np.ndarray, h: np.ndarray, n_texts: int) -> np.ndarray:
    """Minima of TREES * DEPTH hash functions over each text's shingles; all ones for a text without any."""
    out = np.full((n_texts, len(_FACTORS)), 0xFFFFFFFF, np.uint32)
    if len(h):
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        rows = own[first]
        for k, f in enumerate(_FACTORS):
            out[rows, k] = np.minimum.reduceat((h * f) >> np.uint64(32), first)
    return out


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from raw bytes and offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _rows_of(matrix: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(matrix).view(np.uint8).reshape(len(matrix), -1)
    return _binary(flat, np.arange(len(matrix) + 1) * flat.shape[1])


def _keys(own: np.ndarray, h: np.ndarray, n_texts: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Size of each set, and two numbers that tell sets apart."""
    n = np.bincount(own, minlength=n_texts)
    out = []
    for salt in (0x1234567, 0x89ABCDEF01):
        k = np.zeros(n_texts, np.uint64)
        if len(h):
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            k[own[first]] = np.add.reduceat(mix(h ^ np.uint64(salt)), first)
        out.append(k.view(np.int64))
    return n, out


def _measure(k: int, full: bool):
    """Scan texts; ``full``: for the sets themselves, else for their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, t in chunks(batch.column("text")):
                own, h = shingles(t, k)
                n, (a, b) = _keys(own, h, t.n)
                if full:
                    last = _binary(h, np.append(0, np.cumsum(n)) * 8)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), last], names=["a", "b", "items"])
                    continue
                rows = batch.slice(i, j - i)
                sig = _rows_of(signatures(own, h, t.n))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("row", "doc_id", "text_key")), pa.array(n), pa.array(a), pa.array(b), sig], names=["row", "doc_id", "text_key", "n", "a", "b", "sig"])

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def _bytes_of(col: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(col), width)


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class once for every tree, with its place in that order."""
    for batch in batches:
        sig = _bytes_of(batch.column("sig"), 4 * TREES * DEPTH).view("<u4")
        sketch = _rows_of((sig[:, :SKETCH] & 0xFF).astype(np.uint8))
        for t in range(TREES):
            key = _rows_of(sig[:, t * DEPTH : (t + 1) * DEPTH].astype(">u4"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), key, batch.column("class"), batch.column("n"), sketch], names=["tree", "key", "class", "n", "sketch"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between candidates of one task's run of the sorted orders: enough to join them, no more."""
    table = _whole(batches)
    if table is None:
        return
    key = _bytes_of(table["key"], 4 * DEPTH).reshape(-1, DEPTH, 4)
    tree, cls, n = (table[c].to_numpy() for c in ("tree", "class", "n"))
    sketch = _bytes_of(table["sketch"], SKETCH)
    same = (key[1:] == key[:-1]).all(axis=2)
    lcp = np.zeros(len(cls) + 1, np.int64)  # with the row before; 0 past the end
    lcp[1:-1] = np.where(tree[1:] == tree[:-1], np.cumprod(same, axis=1).sum(axis=1), 0)
    u, v = [], []
    live = [(0, len(cls))]
    for depth in range(1, DEPTH + 1):
        deeper = []
        for lo, hi in live:
            cut = np.append(lo + np.flatnonzero(lcp[lo:hi] < depth), hi)
            if cut[0] != lo:
                cut = np.append(lo, cut)
            size = np.diff(cut)
            for k in np.flatnonzero(size > 1):
                s, e = int(cut[k]), int(cut[k + 1])
                if e - s > REGION and depth < DEPTH:
                    deeper.append((s, e))
                else:
                    # stars around the smallest class, which is what the components are named after
                    order = np.argsort(cls[s:e])
                    c = cls[s:e][order]
                    root = np.zeros(e - s, np.int64) if e - s > REGION else _joined(sketch[s:e][order], n[s:e][order])
                    moved = np.flatnonzero(root != np.arange(e - s))
                    if len(moved):
                        u.append(c[root[moved]])
                        v.append(c[moved])
        live = deeper
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])


def _joined(sketch: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first member that each member of a region reaches through agreeing sketches and sizes."""
    agree = np.zeros((len(n), len(n)), np.uint8)
    for c in range(SKETCH):
        agree += sketch[:, None, c] == sketch[None, :, c]
    ok = (agree >= AGREE) & (100 * np.minimum(n[:, None], n) >= PERCENT * np.maximum(n[:, None], n))
    return _reach(ok)


def _reach(ok: np.ndarray) -> np.ndarray:
    """The first node that each node reaches, for a symmetric adjacency matrix."""
    m = len(ok)
    root = np.arange(m)
    if ok.sum() <= np.trace(ok):
        return root
    while True:
        low = np.minimum(root, np.where(ok, root[None, :], m).min(axis=1))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, by products of incidence matrices."""
    m = len(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    items = np.concatenate(sets)
    order = np.argsort(items, kind="stable")
    items, who = items[order], who[order]
    new = np.ones(len(items), bool)
    new[1:] = items[1:] != items[:-1]
    code = np.cumsum(new) - 1
    often = np.bincount(code) > 1
    keep = often[code]
    code, who = (np.cumsum(often) - 1)[code[keep]], who[keep]
    out = np.zeros((m, m))
    width = 1 << 14
    for lo in range(0, int(often.sum()), width):
        a, b = np.searchsorted(code, [lo, lo + width])
        x = np.zeros((m, width), np.float32)
        x[who[a:b], code[a:b] - lo] = 1
        out += x @ x.T
    return np.rint(out).astype(np.int64)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links of each block (cluster, i, j); rows of a block stand together.

    ``label`` joins what is linked already; a row with ``outside`` false meets only rows with it true.
    """
    key, block = None, []

    def links() -> pa.RecordBatch | None:
        m = len(block)
        if m < 2:
            return None
        cls = np.array([r[0] for r in block])
        label = np.array([r[1] for r in block])
        out = np.array([r[2] for r in block])
        sets = [np.frombuffer(r[3], np.uint64) for r in block]
        n = np.array([len(s) for s in sets])
        both = shared(sets)
        ok = 100 * both >= PERCENT * (n[:, None] + n - both)
        ok &= out[:, None] | out
        same = label[:, None] == label
        # one link for each part that was not yet joined, to the first class that it is now joined with
        root, part = _reach(ok | same), _reach(same)
        moved = np.flatnonzero((part == np.arange(m)) & (root != part))
        u, v = cls[root[moved]], cls[moved]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"]) if len(moved) else None

    for batch in batches:
        cols = [batch.column(c) for c in ("cluster", "i", "j", "class", "label", "outside", "items")]
        head = list(zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in cols[:6]), strict=True))
        for r, items in zip(head, cols[6], strict=True):
            if r[:3] != key:
                if (got := links()) is not None:
                    yield got
                key, block = r[:3], []
            block.append((r[3], r[4], r[5], items.as_py()))
    if (got := links()) is not None:
        yield got


_BLOCK = ["cluster", "i", "j", "class", "label", "outside", "items"]


def _blocks(rows: DataFrame) -> DataFrame:
    dealt = rows.select(*_BLOCK).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "class")
    return materialise(dealt.mapInArrow(_confirm, "u bigint, v bigint"), "near-links")


def _spread(n: F.Column) -> F.Column:
    """How many chunks n rows take."""
    return F.ceil(n / CHUNK).cast("bigint")


def _links(members: DataFrame) -> DataFrame:
    """Confirmed links (u, v) that join all that is linked; ``members``: class, cluster, items."""
    size = members.groupBy("cluster").agg(F.count("*").alias("size"))
    size = materialise(size, "cluster-sizes")
    m = materialise(members.join(small_side(size), "cluster"), "cluster-members")
    chunk = F.pmod(F.xxhash64("class"), _spread(F.col("size")))
    pivot = (F.col("size") > CHUNK) & (F.pmod(F.xxhash64("class", F.lit("pivot")), F.col("size")) < PIVOTS)
    where = F.when(pivot, F.sequence(F.lit(0).cast("bigint"), _spread(F.col("size")) - 1)).otherwise(F.array(chunk))
    first = m.select("cluster", F.explode(where).alias("i"), F.lit(0).cast("bigint").alias("j"), "class", F.col("class").alias("label"), F.lit(True).alias("outside"), "items")
    links = _blocks(first)
    discard(size)
    if not m.filter(F.col("size") > CHUNK).head(1):
        discard(m)
        return links
    large = m.filter(F.col("size") > CHUNK)
    root = components(links)
    labelled = large.join(small_side(root), large["class"] == root["node"], "left").withColumn("label", F.coalesce("root", "class")).drop("node", "root")
    labelled = materialise(labelled, "cluster-labels")
    by_label = labelled.groupBy("cluster", "label").agg(F.count("*").alias("c"))
    main = by_label.groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("main"), (F.sum("c") - F.max("c")).alias("out"))
    main = materialise(main.filter("out > 0"), "cluster-main")
    rest = labelled.join(small_side(main), "cluster").withColumn("outside", F.col("label") != F.col("main"))
    chunks_in, chunks_out = _spread(F.col("size")), _spread(F.col("out"))
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    # an outsider is in the rows of its chunk of outsiders; all others in the columns of theirs, and outsiders there too
    as_row = rest.filter("outside").select("cluster", F.pmod(F.xxhash64("class", F.lit("out")), chunks_out).alias("i"), F.explode(upto(chunks_in)).alias("j"), "class", "label", "outside", "items")
    as_col = rest.select("cluster", F.explode(upto(chunks_out)).alias("i"), F.pmod(F.xxhash64("class"), chunks_in).alias("j"), "class", "label", F.lit(False).alias("outside"), "items")
    more = _blocks(as_row.union(as_col))
    discard(m, root, labelled, main)
    return links.union(more)


def resolve(docs: DataFrame, k: int = 2, row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_shingles, component_id and ``leader``, a row that stands for the component."""
    narrow = docs.select(
        (F.col(row).cast("bigint") if row else F.monotonically_increasing_id()).alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("text_key"),
    )
    measured = materialise(narrow.mapInArrow(_measure(k, False), "row bigint, doc_id bigint, text_key bigint, n bigint, a bigint, b bigint, sig binary"), "near-signatures")
    classes = measured.filter("n > 0").groupBy("a", "b", "n").agg(F.min("row").alias("class"), F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("sig").alias("sig"))
    classes = materialise(classes, "near-classes")

    placed = classes.filter(F.col("n") >= LEAST).select("class", "n", "sig").mapInArrow(_orders, "tree int, key binary, class bigint, n bigint, sketch binary")
    tasks = max(1, -(-TREES * classes.count() // TASK_ROWS))
    ordered = placed.repartitionByRange(tasks, "tree", "key", "class").sortWithinPartitions("tree", "key", "class")
    clusters = components(ordered.mapInArrow(_candidates, "u bigint, v bigint"))

    inside = classes.drop("sig").join(small_side(clusters), F.col("class") == F.col("node"))
    inside = materialise(inside.select("class", F.col("root").alias("cluster"), "a", "b", F.col("at.doc_id").alias("at_doc"), F.col("at.text_key").alias("at_key")), "near-inside")
    few = small_side(inside.select("at_doc", "at_key").distinct(), inside.count())
    texts = narrow.join(few, F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("text_key") == F.col("at_key")), "left_semi").select("text")
    sets = texts.mapInArrow(_measure(k, True), "a bigint, b bigint, items binary")
    members = sets.join(small_side(inside.select("class", "cluster", "a", "b"), inside.count()), ["a", "b"]).select("class", "cluster", "items").dropDuplicates(["class"])
    members = materialise(members, "near-sets")
    found = components(_links(members))
    discard(inside, members, clusters)

    labels = classes.select("class", "a", "b", "first").join(found, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    labels = materialise(labels.select("class", "a", "b", "first", "root"), "near-labels")
    ids = materialise(labels.groupBy("root").agg(F.min("first").alias("component_id"), F.min("class").alias("leader")), "near-components")
    by_set = materialise(labels.join(ids, "root").select("a", "b", "component_id", "leader"), "near-by-set")
    discard(classes, found, labels, ids)
    m = measured.select("row", "doc_id", F.col("n").alias("n_shingles"), "a", "b")
    out = m.filter("n_shingles > 0").join(by_set, ["a", "b"]).select("row", "doc_id", "n_shingles", "component_id", "leader")
    alone = m.filter("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("leader"))
    return out.union(alone)


def query(docs: DataFrame) -> DataFrame:
    out = resolve(docs, 2)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5) -> DataFrame:
    """The rows of ``docs`` with one row of each component, that of its smallest doc_id."""
    held, row = numbered(docs, "near-documents")
    with scope() as used:
        resolved = resolve(held, k, row)
    rows = materialise(resolved, "near-rows")
    for path in used:
        delete(docs.sparkSession, path)
    # of the rows that carry the component's id, the first
    first = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("leader").agg(F.min("row").alias("keep"))
    return without(held, row, rows.join(first, rows["row"] == first["keep"], "left_anti").select(rows["row"]))
