"""Exact removal of repeated 100-byte strings by merging shard Burrows-Wheeler transforms.

Every 100-byte window of a text has a minimizer, the smallest hash among its ``GRAM``-byte substrings. Equal windows have
equal minimizers at equal places, so windows meet in buckets by minimizer, and texts never have to be sorted as a whole.
Runs of neighbouring windows with one minimizer make a record. Minimizers that occur once are dropped with a bitmap of
bounded size (it only sifts; what it lets through falls out later). As in prefix-free parsing, equal records are folded to
their first, so copies and common passages are one record of the dictionary whose transform is built.

In the buckets that hold different records, the records are dealt to shards. Each shard's transform is built, with the
step from a row to the row of the suffix two bytes before it. The shards are merged by interleave refinement: the
interleave of all shards starts in shard order, and every pass orders it by the two symbols before each row with a stable
counting sort. A pass keeps the rows that still share their block with another row and from which a window's start can be
reached, so after 50 passes the blocks are the repeated intervals of strings of 100 bytes, and the pass in which two
neighbours part gives their common prefix; no suffix is sorted again. The first start of an interval stays, every other
start covers 100 bytes.

A bucket of over ``HOT`` different records (a passage met by very many contexts) is not put in one task: its windows are
dealt to finer buckets by a longer string that they share, first all but ``WIDTH - 1`` of their bytes, then all of them, and
go the same way from there.

Defined results: a null text is empty; texts under 100 bytes lose nothing; null ids come after all ids; texts under one
id are ordered by a hash of the text; rows equal in id and text are one document, listed as often as it was; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsq.llm.common import bitmap_of, drop_table, holds, read_documents, stage_table, text_of
from tsq.llm.kernels import mix, powers, runs, text_buffer

LENGTH = 100
GRAM = 28
SHARDS = 4
UNIT_BYTES = 1 << 20
TASK_BYTES = 4 << 20
HOT = 20_000
WIDTH = 16
_U = np.uint64
_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all substrings of ``gram`` bytes, equal for equal bytes."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTES[data] * up[:-1], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> _U(31)
    h *= _U(0x7FB5D329728EA185)
    h ^= h >> _U(29)
    return h


def records(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(document, start, windows, minimizer) of the records of a run of documents, and all substring hashes.

    Starts count from the run's start.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U))
    if len(data) < length:
        return none
    h = gram_hashes(data, gram)
    span = length - gram + 1
    low, have = h, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    valid = np.zeros(len(low), dtype=bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= length:
            valid[a : b - length + 1] = True
    new = np.ones(len(low), dtype=bool)
    new[1:] = low[1:] != low[:-1]
    new[offsets[:-1][offsets[:-1] < len(low)]] = True
    gap = np.zeros(len(low), dtype=bool)
    gap[1:] = valid[1:] & ~valid[:-1]
    starts = np.flatnonzero((new | gap) & valid)
    stops = np.append(starts[1:], len(low))
    count = np.concatenate([[0], np.cumsum(valid)])
    size = count[stops] - count[starts]
    if size.max(initial=0) > span:
        pieces = -(-size // span)
        at = np.repeat(np.arange(len(starts)), pieces)
        k = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, size = starts[at] + k * span, np.minimum(span, size[at] - k * span)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return doc, starts, size, low[starts], h


def repeats_inside(h: np.ndarray, start: np.ndarray, size: np.ndarray, mh: np.ndarray, span: int) -> np.ndarray:
    """Whether a record meets its minimizer twice, as it must to hold two equal windows."""
    out = np.zeros(len(start), dtype=bool)
    steps = np.arange(2 * span - 1)
    for a in range(0, len(start), 4096):
        s, k = start[a : a + 4096, None], size[a : a + 4096, None]
        at = s + steps
        same = (h[np.minimum(at, len(h) - 1)] == mh[a : a + 4096, None]) & (steps < k + span - 1)
        out[a : a + 4096] = same.sum(axis=1) > 1
    return out


class Shard:
    """The transform of records, each closed by a mark; marks sort after all bytes, by record.

    ``rows`` are the suffixes' starts in sorted order, ``symbol`` the two bytes before each, ``back`` the row of the suffix
    that starts two bytes earlier (-1 where the record has none).
    """

    def __init__(self, texts: list[bytes]):
        length = np.array([len(t) + 1 for t in texts])
        n = int(length.sum())
        raw = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(length) - 1
        one = raw + 1
        one[ends] = 257  # a mark, told apart by its record further down
        padded = np.concatenate([one, np.zeros(6, dtype=np.int64)])
        key = np.zeros(n, dtype=np.int64)
        for k in range(6):
            key = key * 258 + padded[k : k + n]
        rank, step = self._ranks(key), 6
        record = np.repeat(np.arange(len(texts)), length)
        # what lies behind a mark is another record; there the records' own order decides
        left = np.repeat(ends, length) - np.arange(n)
        while step < 2 * int(length.max(initial=1)):
            later = np.zeros(n, dtype=np.int64)
            later[: n - step] = rank[step:] + 1 if step < n else 0
            later = np.where(left < step, record, later + len(texts))
            new = self._ranks(rank * (n + len(texts) + 2) + later)
            if int(new.max()) == n - 1:
                rank = new
                break
            rank, step = new, 2 * step
        self.rows = np.argsort(rank, kind="stable")
        place = np.empty(n, dtype=np.int64)
        place[self.rows] = np.arange(n)
        first = np.repeat(np.cumsum(length) - length, length)
        has = np.arange(n) - first >= 2
        before = np.where(has, np.arange(n) - 2, 0)
        pair = (raw[before] << 8) | raw[np.minimum(before + 1, n - 1)]
        self.symbol = pair[self.rows].astype(np.uint16)
        self.back = np.where(has, place[before], -1)[self.rows]
        self.place = place
        self.first = np.cumsum(length) - length

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        up = np.zeros(len(key), dtype=np.int64)
        up[1:] = np.cumsum(np.diff(key[order]) != 0)
        out = np.empty(len(key), dtype=np.int64)
        out[order] = up
        return out


def merge(shards: list[Shard], starts: list[np.ndarray], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, block): rows of the concatenated shards whose suffixes share their first ``depth`` symbols with another's.

    ``starts`` are by shard the suffixes asked for, as places in the shard's text; ``depth`` is even. The interleave holds
    the rows of the suffixes ``depth`` further on, and every pass goes back by two symbols.
    """
    base = np.cumsum([0, *(len(x.rows) for x in shards)])
    symbol = np.concatenate([x.symbol for x in shards])
    back = np.concatenate([np.where(x.back < 0, -1, x.back + o) for x, o in zip(shards, base, strict=False)])
    row = np.concatenate([np.sort(x.place[s + depth]) + o for x, s, o in zip(shards, starts, base, strict=False)])
    block = np.zeros(len(row), dtype=np.int64)
    for _ in range(depth // 2):
        top = symbol[row]
        order = np.argsort(top, kind="stable")
        row, top, old = row[order], top[order], block[order]
        cut = np.ones(len(row) + 1, dtype=bool)
        cut[1:-1] = (top[1:] != top[:-1]) | (old[1:] != old[:-1])
        shared = ~(cut[:-1] & cut[1:])
        row, block = back[row[shared]], np.cumsum(cut[:-1])[shared]
        if not len(row):
            break
    return row, block


def later_windows(texts: list[bytes], rank: np.ndarray, length: int = LENGTH, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """(record, offset) of every window that an earlier one equals; ``rank`` gives the records' order."""
    mine = [np.arange(s, len(texts), shards) for s in range(min(shards, len(texts)))]
    parts = [Shard([texts[k] for k in m.tolist()]) for m in mine]
    size = np.array([len(t) for t in texts])
    starts = []
    for m, part in zip(mine, parts, strict=True):
        count = np.maximum(size[m] - length + 1, 0)
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        starts.append(np.repeat(part.first, count) + within)
    row, block = merge(parts, starts, length)
    base = np.cumsum([0, *(len(p.rows) for p in parts)])
    which = np.searchsorted(base, row, side="right") - 1
    record, offset = np.empty(len(row), dtype=np.int64), np.empty(len(row), dtype=np.int64)
    for s, (m, part) in enumerate(zip(mine, parts, strict=True)):
        own = which == s
        at = part.rows[row[own] - base[s]]
        k = np.searchsorted(part.first, at, side="right") - 1
        record[own], offset[own] = m[k], at - part.first[k]
    order = np.lexsort((offset, rank[record], block))
    record, offset, block = record[order], offset[order], block[order]
    lead = np.ones(len(block), dtype=bool)
    lead[1:] = block[1:] != block[:-1]
    return record[~lead], offset[~lead]


def _minimizers(own: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for _, _, part, at in runs(data, offsets):
                _, start, size, mh, h = records(part, at, length, gram)
                inner = repeats_inside(h, start, size, mh, length - gram + 1)
                mh = np.sort(np.concatenate([mh, mh[inner]]))
                lead = np.ones(len(mh), dtype=bool)
                lead[1:] = mh[1:] != mh[:-1]
                times = np.diff(np.append(np.flatnonzero(lead), len(mh)))
                yield pa.RecordBatch.from_arrays([pa.array(mh[lead].view(np.int64)), pa.array(np.minimum(times, 2).astype(np.int32))], names=["mh", "n"])

    return own.mapInArrow(run, "mh long, n int")


FOUND = "bucket long, digest long, id long, tag long, start int, size int, inner boolean, content binary"
_NAMES = ["bucket", "digest", "id", "tag", "start", "size", "inner", "content"]


def _row_batch(bucket, ids, tags, start, content: list[bytes], inner) -> pa.RecordBatch:
    digest = np.fromiter(map(xxhash.xxh3_64_intdigest, content), dtype=_U, count=len(content)).view(np.int64)
    size = np.fromiter(map(len, content), dtype=np.int32, count=len(content))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket), pa.array(digest), ids, tags, pa.array(start.astype(np.int32)), pa.array(size), pa.array(inner), pa.array(content, pa.binary())], names=_NAMES
    )


def _candidates(own: DataFrame, held, length: int, gram: int) -> DataFrame:
    """Records whose minimizer the bitmap holds; ``inner`` tells that a record may repeat a window itself."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for i, _, part, at in runs(data, offsets):
                doc, start, size, mh, h = records(part, at, length, gram)
                hit = holds(held.value, mh)
                doc, start, size, mh = doc[hit], start[hit], size[hit], mh[hit]
                inner = repeats_inside(h, start, size, mh, length - gram + 1)
                raw = part.tobytes()
                content = [raw[s : s + k + length - 1] for s, k in zip(start.tolist(), size.tolist(), strict=True)]
                row = pa.array(i + doc)
                yield _row_batch(mh.view(np.int64), batch.column(0).take(row), batch.column(1).take(row), start - at[doc], content, inner)

    return own.mapInArrow(run, FOUND)


def _finer(hot: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """The windows of hot records in finer buckets: a bucket's windows share all but ``width - 1`` of their bytes.

    A minimizer first starts ``far`` bytes into a window, which equal windows have in common; windows of one record with one
    such start and one ``far // width`` stay together. With a width of 1 every window is alone, and buckets need not be
    minimizers.
    """

    def run(batches):
        for batch in batches:
            bucket, at, content, out, start, source = [], batch.column(4).to_pylist(), batch.column(7).to_pylist(), [], [], []
            for k, (mh, text) in enumerate(zip(batch.column(0).to_numpy().view(_U), content, strict=True)):
                s = np.arange(len(text) - length + 1)
                lead = np.flatnonzero(gram_hashes(np.frombuffer(text, dtype=np.uint8), gram) == mh) if width > 1 else s
                o = lead[np.searchsorted(lead, s)]
                part = (o - s) // width
                edge = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (part[1:] != part[:-1])))
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(s)], strict=True):
                    g = int(part[a])
                    core = text[int(o[a]) - g * width : int(o[a]) - g * width + length + 1 - width]
                    bucket.append(xxhash.xxh3_64_intdigest(core, seed=(width << 32) + g) ^ int(mh))
                    out.append(text[a : b - 1 + length])
                    start.append(at[k] + a)
                    source.append(k)
            row = pa.array(source, pa.int64())
            yield _row_batch(
                np.array(bucket, dtype=_U).view(np.int64), batch.column(2).take(row), batch.column(3).take(row), np.array(start), out, np.zeros(len(out), dtype=bool)
            )

    return hot.select(*_NAMES).mapInArrow(run, FOUND)


SPAN = "id long, tag long, s int, e int"


def _merged(reps: DataFrame, total: int, length: int, unit: int = UNIT_BYTES) -> DataFrame:
    """Spans of the later windows of records ``(bucket, id, tag, start, content)`` of ``total`` bytes, dealt by bucket."""

    def solve(rows):
        texts = [r[4] for r in rows]
        order = sorted(range(len(rows)), key=lambda k: (rows[k][1], rows[k][2], rows[k][3]))
        rank = np.empty(len(rows), dtype=np.int64)
        rank[order] = np.arange(len(rows))
        record, offset = later_windows(texts, rank, length)
        order = np.lexsort((offset, record))
        record, offset = record[order], offset[order]
        # neighbouring windows of a record make one span
        edge = np.ones(len(record) + 1, dtype=bool)
        edge[1:-1] = (record[1:] != record[:-1]) | (offset[1:] > offset[:-1] + length)
        first = np.flatnonzero(edge[:-1])
        which = record[first]
        begin = np.array([r[3] for r in rows], dtype=np.int64)[which]
        end = begin + offset[np.flatnonzero(edge[1:])] + length
        ids = [np.array([r[c] for r in rows], dtype=np.int64)[which] for c in (1, 2)]
        return pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array((begin + offset[first]).astype(np.int32)), pa.array(end.astype(np.int32))], names=["id", "tag", "s", "e"])

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and size >= unit:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
                last = row[0]
        if rows:
            yield solve(rows)

    # a stated number of tasks: the work is in the sorting, which small sizes hide
    tasks = max(reps.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return reps.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, SPAN)


def _settle(found: DataFrame, length: int, gram: int, hot: int, width: int) -> DataFrame:
    """Spans of all later windows among the records of a staged table, which is dropped with the last that reads it."""
    place = F.struct("id", "tag", "start")
    reps = found.groupBy("bucket", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner"), F.max("size").alias("size"))
    reps = stage_table(reps, "reps")
    copies = found.select("bucket", "digest", "id", "tag", "start", "size").join(reps.where("n > 1").select("bucket", "digest", "first"), ["bucket", "digest"])
    copies = copies.where(F.col("first") < place)
    whole = stage_table(copies.select("id", "tag", F.col("start").alias("s"), (F.col("start") + F.col("size")).cast("int").alias("e")), "spans")
    kinds = reps.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.max("inner").alias("own"), F.sum("size").alias("bytes")).where("k > 1 OR own")
    kinds = stage_table(kinds.select("bucket", "k", "bytes"), "kinds")
    many, most, total = kinds.agg(F.count(F.lit(1)), F.coalesce(F.max("k"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    held = found.sparkSession.sparkContext.broadcast(bitmap_of(kinds.select("bucket"), many))

    def sift(batches):
        for batch in batches:
            yield batch.filter(pa.array(holds(held.value, batch.column(0).to_numpy().view(_U))))

    mixed = found.mapInArrow(sift, FOUND).groupBy("bucket", "digest").agg(F.min(F.struct("id", "tag", "start", "size", "inner", "content")).alias("x"))
    mixed = stage_table(mixed.select("bucket", "digest", "x.*").join(kinds.select("bucket", "k"), "bucket"), "mixed")
    drop_table(found)
    drop_table(reps)
    out = whole.unionByName(_merged(mixed.where(F.col("k") <= hot).select("bucket", "id", "tag", "start", "content"), total, length))
    if most > hot:
        finer = stage_table(_finer(mixed.where(F.col("k") > hot), length, gram, width), "finer")
        # after a width of 1 a bucket has one record, however often it occurs
        out = out.unionByName(_settle(finer, length, gram, hot, 1))
    return out


def repeated_spans(own: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, width: int = WIDTH) -> DataFrame:
    """Spans ``(id, tag, s, e)`` of ``own`` = ``(id, tag, t)`` that earlier strings of ``length`` bytes cover."""
    if length % 2 or gram >= length or not 1 <= width < length - gram:
        raise ValueError("an even length above the substrings' and the width's sum")
    twice = stage_table(_minimizers(own, length, gram).groupBy("mh").agg(F.sum("n").alias("n")).where("n > 1").select("mh"), "twice")
    held = own.sparkSession.sparkContext.broadcast(bitmap_of(twice, twice.count()))
    return _settle(stage_table(_candidates(own, held, length, gram), "records"), length, gram, hot, width)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, **params) -> DataFrame:
    """By row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked, the remaining bytes ``kept``."""
    own = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(text_of(text_col)).alias("tag"), text_of(text_col).alias("t"), F.col(id_col).cast("long").alias("doc_id")
    )
    pair = F.shiftleft(F.col("s").cast("long"), 32) + F.col("e")
    by_doc = repeated_spans(own.select("id", "tag", "t"), length, gram, **params).groupBy("id", "tag").agg(F.collect_list(pair).alias("spans"))
    by_doc = stage_table(by_doc, "by-doc").select("id", "tag", "spans")
    touched = by_doc.select(F.xxhash64("id", "tag").alias("x"))
    held = docs.sparkSession.sparkContext.broadcast(bitmap_of(touched, touched.count()))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(len(names))], names=names)

    def part(inside: bool):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(holds(held.value, batch.column(0).to_numpy().view(_U)) == inside))

        keyed = own.select(F.xxhash64("id", "tag").alias("x"), "id", "tag", "doc_id", "t")
        return keyed.mapInArrow(run, "x long, id long, tag long, doc_id long, t string")

    def whole(batches):
        for batch in batches:
            texts = zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)
            yield table([(i, len(t), 0, 0, hashlib.sha256(t).hexdigest(), t) for i, t in texts])

    def cut(batches):
        for batch in batches:
            out = []
            for i, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True):
                at = np.asarray(spans.values, dtype=np.int64) if spans.is_valid else np.zeros(0, dtype=np.int64)
                edge = np.zeros(len(text) + 1, dtype=np.int32)
                np.add.at(edge, at >> 32, 1)
                np.add.at(edge, at & 0xFFFFFFFF, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                n = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((i, len(text), int(gone.sum()), n, hashlib.sha256(kept).hexdigest(), kept))
            yield table(out)

    # only the texts that lose something move to their spans
    clean = part(False).select("doc_id", "t").mapInArrow(whole, schema)
    return clean.unionByName(part(True).join(by_doc, ["id", "tag"], "left").select("doc_id", "t", "spans").mapInArrow(cut, schema))


def op3_suffix_dedup(spark, sf_dir):
    return remove_repeats(read_documents(spark, sf_dir))
