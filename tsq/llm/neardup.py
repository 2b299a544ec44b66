"""Near-duplicate documents by DartMinHash signatures and banded joining.

Texts are weighted sets of five-word shingles (weight 1 each, or their counts with ``weighted=True``). Each element owns
a plane of (weight, rank); hashed darts arrive along the rank axis as a Poisson process, one process for the weight cell
[0, 1) and one for each further cell [2**j, 2**(j+1)). A dart counts when its weight lies inside the element's weight and
its rank below a threshold set so that a text catches a fixed number of darts whatever its size. Darts fall on
coordinates by hash, the earliest on each coordinate is the signature's value there, and a text that misses a coordinate
throws again with twice the threshold. Two texts agree on a coordinate with probability equal to their (weighted)
Jaccard similarity. ``BANDS`` bands of ``ROWS`` coordinates are the join keys: a pair at 0.8 is missed with probability
below 1e-4.

Every link is verified: candidates pass a signature estimate with a margin of over five standard deviations, then the
shingle sets themselves. No large bucket is expanded into rows of pairs. Equal texts are one node. Each bucket offers its members
one hub; a node is first verified against the hub that it meets in most buckets, components are labelled, and only pairs
across labels go on. Buckets that still hold several labels are settled by all their cross-label pairs: as rows where they
have at most ``SMALL`` members, and beyond that inside groups of two blocks of members, which compare the shingle sets and
give only the links that join labels; both ways compare every pair. The work in such a bucket grows with the square of its members that are outside its
commonest label, the rows with that square over ``BLOCK``.

Defined results: null and empty texts have no shingles and are classes of their own text (equal texts share a class, so
all empty ones do); a text of one to four words is one shingle; repeated rows and ids are copies; a class is named by its
smallest non-null id, or null when it has none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsq.llm.common import bitmap_of, drop_table, holds, read_documents, stage_table, text_of
from tsq.llm.kernels import distinct_sorted, lists, mix, runs, shingles, span_hashes, text_buffer, words

SIZE = 5
SIMILARITY = 0.8
BANDS = 36
ROWS = 6
SMALL = 16
BLOCK = 512
JUMP = 6
HOT = 1000
SALTS = 64
MARGIN = 0.17
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def throw(values: np.ndarray, weights: np.ndarray, doc: np.ndarray, limit: np.ndarray):
    """Darts (doc, rank, id) inside the weighted regions, up to rank ``limit[doc]``."""
    cells = np.where(weights <= 1, 1, 1 + np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64))
    at = np.repeat(np.arange(len(values)), cells)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(cell == 0, 0.0, 2.0 ** (cell - 1))
    width = np.where(cell == 0, 1.0, low)
    seed = mix(values[at] + mix(cell.astype(_U) + _U(1)))
    rank = np.zeros(len(at))
    out, step, block = [], 1, 1
    while len(at):
        raw = mix(seed[:, None] + (np.arange(step, step + block).astype(_U) * _STEP))
        t = rank[:, None] + np.cumsum(-np.log(_unit(raw)) / width[:, None], axis=1)
        inside = t <= limit[doc[at]][:, None]
        r, c = np.nonzero(inside)
        ident = mix(raw[r, c] ^ _U(0x5851F42D4C957F2D))
        hit = low[r] + width[r] * _unit(mix(ident + _U(7))) <= weights[at[r]]
        r, c, ident = r[hit], c[hit], ident[hit]
        out.append((doc[at[r]], t[r, c], ident))
        on = inside[:, -1]
        at, seed, low, width, rank = at[on], seed[on], low[on], width[on], t[on, -1]
        step, block = step + block, min(block * 4, 256)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, _U))


def dart_minhash(values: np.ndarray, bounds: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures, one row of ``k`` ids per document; rows of documents without elements are zero."""
    n = len(bounds) - 1
    weights = np.ones(len(values)) if weights is None else weights
    doc = np.repeat(np.arange(n), np.diff(bounds))
    total = np.bincount(doc, weights=weights, minlength=n)
    limit = k * (np.log(k) + 2.5) / np.maximum(total, 1e-300)
    sig = np.zeros((n, k), dtype=_U)
    todo = total > 0
    while todo.any():
        use = todo[doc]
        d, rank, ident = throw(values[use], weights[use], doc[use], limit)
        slot = d * k + ((ident >> _U(32)) % _U(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        flat = np.zeros(n * k, dtype=_U)
        flat[slot[order]] = ident[order] | _U(1)
        flat = flat.reshape(n, k)
        full = todo & (flat != 0).all(axis=1)
        sig[full] = flat[full]
        todo &= ~full
        limit = limit * 2
    return sig


def elements(data: np.ndarray, offsets: np.ndarray, weighted: bool = False):
    """Distinct shingle hashes by document, bounds, and weights."""
    start, end, at = words(data, offsets)
    h, b = shingles(span_hashes(data, start, end), at, SIZE)
    values, bounds = distinct_sorted(h, b)
    if not weighted:
        return values, bounds, None
    doc = np.repeat(np.arange(len(b) - 1), np.diff(b))
    order = np.lexsort((h, doc))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    first = np.flatnonzero(new)
    return values, bounds, np.diff(np.append(first, len(h))).astype(float)


def signature_batches(batches, bands: int, rows: int, weighted: bool):
    """(doc_id, node, keys, sig) of (doc_id, node, text) batches."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        for i, j, part, at in runs(data, offsets):
            values, bounds, weights = elements(part, at, weighted)
            sig = dart_minhash(values, bounds, bands * rows, weights)
            key = np.zeros((j - i, bands), dtype=_U)
            for b in range(bands):
                h = np.full(j - i, b + 1, dtype=_U)
                for c in range(b * rows, (b + 1) * rows):
                    h = mix(h * _STEP + sig[:, c])
                key[:, b] = h
            has = np.diff(bounds) > 0
            where = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    batch.column(1).slice(i, j - i),
                    lists(key[has].ravel().view(np.int64), where, pa.int64()),
                    pa.array([row.tobytes() for row in sig.astype(np.uint8)], type=pa.binary()),
                ],
                names=["doc_id", "node", "keys", "sig"],
            )


def shingle_sets(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, items)``: sorted distinct shingles of the texts ``(tag, node, t)`` in ``nodes``, which is read three times; a
    bitmap spares the others the work."""
    held = own.sparkSession.sparkContext.broadcast(bitmap_of(nodes.select("tag"), nodes.count()))

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(holds(held.value, batch.column(0).to_numpy().view(_U))))
            data, offsets = text_buffer(batch.column(2))
            for i, j, part, at in runs(data, offsets):
                values, bounds, _ = elements(part, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, j - i), lists(values.view(np.int64), bounds, pa.int64())], names=["node", "items"]
                )

    found = own.select("tag", "node", "t").mapInArrow(run, "node binary, items array<long>")
    return found.join(nodes.select("node"), "node", "left_semi")


def estimate(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """``(a, b, est)`` of the pairs whose signatures agree often enough; byte-sized values agree by chance at 1 in 256."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                est = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                keep = pa.array(est >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(est).filter(keep)], names=["a", "b", "est"])

    left = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary, est double")


def verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have Jaccard similarity ``similarity`` or more."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.asarray(v.values) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            mask = pa.array(keep, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ia", "ib").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of all linked nodes: the smallest node of its component.

    Labels pass along links, own one included, so a pass is one join and one aggregation; hubs keep most paths to a few
    steps, and from ``JUMP`` passes on each label also takes its own label's, which halves longer paths.
    """
    ends = links.select("a", "b")
    both = ends.union(ends.select("b", "a")).union(ends.select("a", "a")).union(ends.select("b", "b")).toDF("a", "b").distinct()
    links = stage_table(both, "links")
    labels = stage_table(links.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    turn = 0
    while True:
        turn += 1
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("label")))
        step = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("new"), own.alias("old"))
        step = stage_table(step.select(F.col("a").alias("node"), "new", "old"), "labels")
        if not step.where("new <> old").limit(1).count():
            return step.select("node", F.col("new").alias("label"))
        labels = step.select("node", F.col("new").alias("label"))
        if turn >= JUMP:
            far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
            labels = labels.join(far, "label").select("node", F.col("far").alias("label"))


def _labelled(df: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Adds ``l<name>``, the label of column ``name``; unlinked nodes are their own."""
    side = labels.select(F.col("node").alias(name), F.col("label").alias(f"l{name}"))
    return df.join(side, name, "left").withColumn(f"l{name}", F.coalesce(f"l{name}", name))


def _forest(near: np.ndarray, start: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join the labels which ``near`` joins, no more than needed; label ``k`` has the rows from ``start[k]`` on."""
    linked = np.logical_or.reduceat(np.logical_or.reduceat(near, start, axis=0), start, axis=1)
    stop = np.append(start[1:], len(near))
    out, fresh = [], np.ones(len(start), dtype=bool)
    for root in range(len(start)):
        todo = [root] if fresh[root] else []
        fresh[root] = False
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(linked[x] & fresh).tolist():
                i, j = divmod(int(near[start[x] : stop[x], start[y] : stop[y]].argmax()), int(stop[y] - start[y]))
                out.append((int(start[x]) + i, int(start[y]) + j))
                fresh[y] = False
                todo.append(y)
    return out


def _overlaps(rows: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many items each two of the sorted item sets share, as a matrix."""
    n = len(rows)
    owner = np.repeat(np.arange(n), [len(x) for x in rows])
    _, item, often = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    use = often[item] > 1
    owner, item = owner[use], np.unique(item[use], return_inverse=True)[1]
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    both = np.zeros((n, n), dtype=np.float32)
    for first in range(0, int(item[-1]) + 1 if len(item) else 0, columns):
        lo, hi = np.searchsorted(item, [first, first + columns])
        has = np.zeros((n, columns), dtype=np.float32)
        has[owner[lo:hi], item[lo:hi] - first] = 1
        both += has @ has.T
    return both


def settle(opened: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` that join all labels of a bucket which any pair of its members ``(key, node, label)`` joins.

    Every pair across labels is compared on the shingle sets. A bucket is dealt out in blocks of about ``block`` members
    and each two blocks are one group, but no two blocks of its commonest label. A group gives fewer links than labels.
    """
    sizes = opened.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"))
    parts = most.select(
        "key",
        F.col("top.label").alias("top"),
        F.ceil((F.col("n") - F.col("top.n")) / block).alias("s"),
        F.ceil(F.col("top.n") / block).alias("d"),
    )
    tag, rare = F.xxhash64(F.lit(1), "node"), F.col("label") != F.col("top")
    dealt = opened.select("key", "node", "label").join(parts, "key")
    dealt = dealt.withColumn("g", F.when(rare, F.pmod(tag, F.col("s"))).otherwise(F.col("s") + F.pmod(tag, F.col("d"))))
    dealt = dealt.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.when(rare, F.col("s") + F.col("d")).otherwise(F.col("s")) - 1)))
    dealt = dealt.select("key", F.least("g", "x").alias("i"), F.greatest("g", "x").alias("j"), "g", "node", "label")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("label")
        node, label, g = (group.column(c).to_pylist() for c in ("node", "label", "g"))
        start = np.array([k for k in range(len(label)) if not k or label[k] != label[k - 1]])
        pairs = []
        if len(start) > 1:
            rows = [np.asarray(x.values) for x in group.column("items")]
            n = np.array([len(x) for x in rows], dtype=float)
            both = _overlaps(rows).astype(float)
            near = both >= similarity * (n[:, None] + n - both) - 1e-9
            code = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(label))))
            near &= code[:, None] != code
            if group.column("i")[0] != group.column("j")[0]:
                near &= np.array(g)[:, None] != np.array(g)
            pairs = _forest(near, start)
        a, b = ([f(node[i], node[j]) for i, j in pairs] for f in (max, min))
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return dealt.join(sets, "node").groupBy("key", "i", "j").applyInArrow(run, "a binary, b binary").distinct()


def duplicate_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    weighted: bool = False,
) -> DataFrame:
    """``(doc_id, node, label, class_id)`` by row: classes are the components of all links at ``similarity`` or more.

    ``node`` is the digest of the text, ``label`` the smallest of the class. ``weighted`` sets the signature's weights to shingle counts; links are verified on
    sets, and counts only make candidates of texts that repeat themselves alike.
    """
    node = F.unhex(F.md5(text_of(text_col)))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), node.alias("node"), F.xxhash64(node).alias("tag"), text_of(text_col).alias("t"))
    signed = stage_table(
        own.select("doc_id", "node", "t").mapInArrow(lambda b: signature_batches(b, bands, rows, weighted), "doc_id long, node binary, keys array<long>, sig binary"), "signed"
    )
    ids = stage_table(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "ids")
    texts = stage_table(signed.dropDuplicates(["node"]).select("node", "keys", "sig"), "texts")
    sigs = texts.select("node", "sig")
    entries = texts.select(F.xxhash64("node").alias("tag"), "node", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.min("tag").alias("x"), F.max("tag").alias("y")).where("x <> y").select("key")
    hits = stage_table(entries.join(shared, "key", "left_semi"), "hits")
    nodes = stage_table(hits.select("tag", "node").distinct(), "nodes")
    sets = stage_table(shingle_sets(own, nodes).dropDuplicates(["node"]), "sets")
    drop_table(nodes)

    hubs = hits.groupBy("key").agg(F.min(F.struct("tag", "node")).alias("hub"))
    met = hits.join(hubs, "key").where("node <> hub.node").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("node").agg(F.max_by("hub.node", F.struct("n", -F.col("hub.tag"))).alias("b")).select(F.col("node").alias("a"), "b")
    links = stage_table(verify(best, sets, similarity), "links")
    labels = components(links)
    known = _labelled(hits.select("key", F.col("node").alias("a")), labels, "a").select("key", F.col("a").alias("node"), F.col("la").alias("label"))
    open_keys = known.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y").select("key", "n")
    opened = stage_table(known.join(open_keys, "key"), "open")
    few = opened.where(F.col("n") <= SMALL)
    a = few.select("key", F.col("node").alias("a"), F.col("label").alias("la"))
    b = few.select("key", F.col("node").alias("b"), F.col("label").alias("lb"))
    # at most SMALL - 1 partners a row
    pairs = a.join(b, "key").where("la < lb").select("a", "b").distinct()
    more = verify(estimate(pairs, sigs, similarity - MARGIN).select("a", "b"), sets, similarity)
    wide = settle(opened.where(F.col("n") > SMALL), sets, similarity, BLOCK)
    labels = components(links.union(stage_table(more.union(wide), "links")))
    for table in (texts, hits, sets, opened):
        drop_table(table)

    classes = labels.join(ids.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("class_rep"))
    by_node = (
        ids.join(labels, "node", "left")
        .join(classes, "label", "left")
        .select(
            "node",
            "copies",
            F.coalesce("label", "node").alias("label"),
            F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("class_rep")).alias("class_id"),
        )
    )
    return _by_row(signed.select("doc_id", "node"), by_node)


def _by_row(rows: DataFrame, by_node: DataFrame) -> DataFrame:
    """Joins what is known of each node to its rows. A node with over ``1 / HOT`` of all rows, of which there are fewer than
    ``HOT``, meets them in ``SALTS`` parts."""
    total = by_node.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.col("copies") > max(total / HOT, SALTS)
    salted = by_node.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    names = by_node.where(hot).select("node", F.lit(True).alias("hot"))
    dealt = rows.join(F.broadcast(names), "node", "left")
    dealt = dealt.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    return dealt.join(salted, ["node", "salt"]).select("doc_id", "node", "label", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One document of each class, with all its columns: the one with the class's smallest id, then smallest digest."""
    classes = stage_table(duplicate_classes(docs, id_col, text_col, **params), "classes")
    chosen = (
        classes.groupBy("label")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("v"), "doc_id", "node")).alias("x"))
        .select(F.col("x.node").alias("_node"), F.coalesce(F.col("x.doc_id").cast("string"), F.lit("null")).alias("_id"))
    )
    names = docs.columns
    rows = docs.select(
        F.unhex(F.md5(text_of(text_col))).alias("_node"),
        F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null")).alias("_id"),
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
    )
    once = Window.partitionBy("_node", "_id").orderBy(F.lit(1))
    return rows.join(chosen, ["_node", "_id"]).withColumn("_k", F.row_number().over(once)).where("_k = 1").select("_row.*")


def op7_near_dedup(spark, sf_dir):
    return duplicate_classes(read_documents(spark, sf_dir)).select("doc_id", "class_id")
