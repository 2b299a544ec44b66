"""Substring dedup by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut where the gear hash of the last 16 bytes has ``mask_bits`` zero bits, so cuts depend on
nearby content alone and an insertion moves only the chunks it touches. Stretches without a cut are cut every
``max_chunk`` bytes. Chunks are compared by a 128-bit digest over all documents; the first occurrence (smallest id, then
hash of the text, then place) owns a digest. A maximal run of neighbouring repeated chunks is a repeat when it has at
least ``min_run`` bytes, or is the whole text, and so is the stretch of it that earlier occurrences own. Shorter runs are
counted apart and left in place: single chunks repeat by chance in clean text.

Digests of over ``1 / HOT`` of all repeated chunks, of which there are fewer than ``HOT``, are looked up from a broadcast
table, so no hot chunk meets its owner in one task.

Defined results: a null text is empty and has no chunks; rows with a null id come after all ids; unlike texts under one id
are told apart by their hash, and of rows equal in id and text one, whichever, is first; a cut inside a character moves
back to its start; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsq.llm.common import drop_table, read_documents, stage_table, text_of
from tsq.llm.kernels import mix, runs, text_buffer

MASK_BITS = 5
MAX_CHUNK = 256
MIN_RUN = 48
REACH = 16
HOT = 1000
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(48)).astype(np.uint16)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after every byte: each step shifts by one bit and adds the byte's table value.

    Sixteen steps shift a byte out, so doubling the reach four times gives the rolling value everywhere at once.
    """
    h = _GEAR[data]
    for k in range(4):
        step = 1 << k
        h[step:] += h[:-step] << np.uint16(step)
    return h


def cut_points(data: np.ndarray, offsets: np.ndarray, mask_bits: int = MASK_BITS, max_chunk: int = MAX_CHUNK) -> np.ndarray:
    """All chunk boundaries of a run of documents, document bounds included, in order."""
    local = np.flatnonzero((gear_hash(data) >> np.uint16(16 - mask_bits)) == 0) + 1
    doc = np.searchsorted(offsets, local, side="left") - 1
    # nearer than REACH to its document's start the hash would see the text before it
    cuts = np.union1d(local[local - offsets[doc] >= REACH], offsets)
    gap = np.diff(cuts)
    wide = np.flatnonzero(gap > max_chunk)
    if len(wide):
        extra = [np.arange(cuts[k] + max_chunk, cuts[k + 1], max_chunk) for k in wide]
        cuts = np.union1d(cuts, np.concatenate(extra))
    # back to the start of a character, so that what is left of a text stays text
    for _ in range(3):
        inside = np.append(data, np.uint8(0))[cuts] & 0xC0 == 0x80
        if not inside.any():
            break
        cuts = cuts - inside
    return np.unique(cuts)


def chunks_of(column: pa.Array, mask_bits: int, max_chunk: int):
    """(document, start, size, hi, lo) arrays of the chunks of a batch of texts; an empty text gives one of size 0."""
    data, offsets = text_buffer(column)
    for first, _, part, bounds in runs(data, offsets):
        cuts = cut_points(part, bounds, mask_bits, max_chunk)
        raw = part.tobytes()
        digest = xxhash.xxh3_128_digest
        start, end = cuts[:-1], cuts[1:]
        joined = b"".join([digest(raw[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)])
        pair = np.frombuffer(joined, dtype=">i8").astype(np.int64).reshape(-1, 2)
        doc = np.searchsorted(bounds, start, side="right") - 1
        yield first + doc, start - bounds[doc], end - start, pair[:, 0], pair[:, 1]
        void = np.flatnonzero(np.diff(bounds) == 0)
        if len(void):
            zero = np.zeros(len(void), dtype=np.int64)
            yield first + void, zero, zero, zero, zero


TABLE = "row long, doc_id long, tag long, start int, size int, hi long, lo long"


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("tag"), text_of(text_col).alias("t"))


def chunk_table(own: DataFrame, mask_bits: int = MASK_BITS, max_chunk: int = MAX_CHUNK) -> DataFrame:
    """One row per chunk of ``(row, doc_id, tag, t)``: its row's number, id and hash, first byte in the row, size and digest."""

    def run(batches):
        for batch in batches:
            own = batch.columns[:3]
            for doc, start, size, hi, lo in chunks_of(batch.column(3), mask_bits, max_chunk):
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(at) for c in own), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(hi), pa.array(lo)],
                    names=["row", "doc_id", "tag", "start", "size", "hi", "lo"],
                )

    return own.mapInArrow(run, TABLE)


def repeated_spans(table: DataFrame) -> DataFrame:
    """Stretches of neighbouring repeated chunks of one kind: ``row, run, later, owned, start, bytes``.

    ``run`` names the maximal run of repeated chunks, ``later`` whether an earlier occurrence owns the stretch. ``table`` is a
    staged one; its files go once the repeated chunks are copied out of it.
    """
    # a count by half a digest finds every repeat, and the few strangers it lets through go at the full digest below
    often = table.where("size > 0").groupBy("lo").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("lo")
    hits = stage_table(table.where("size > 0").join(often, "lo", "left_semi"), "chunk-hits")
    drop_table(table)
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "tag", "row", "start")
    owners = hits.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    owners = stage_table(owners, "owners")
    total = owners.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(owners.where(F.col("n") > max(total / HOT, HOT)).select("hi", "lo", "first"))
    cold = owners.where(F.col("n") <= max(total / HOT, HOT)).select("hi", "lo", "first")
    known = hits.join(hot, ["hi", "lo"]).unionByName(hits.join(hot.drop("first"), ["hi", "lo"], "left_anti").join(cold, ["hi", "lo"]))
    marked = known.select("row", "start", "size", (F.col("first") < place).alias("later"))
    # the bytes up to a chunk's end that are not of its kind stay the same while neighbours follow each other
    end, until = F.col("start") + F.col("size"), (Window.unboundedPreceding, Window.currentRow)
    run = end - F.sum("size").over(Window.partitionBy("row").orderBy("start").rowsBetween(*until))
    owned = end - F.sum("size").over(Window.partitionBy("row", "later").orderBy("start").rowsBetween(*until))
    return (
        marked.withColumn("run", run)
        .withColumn("owned", owned)
        .groupBy("row", "run", "later", "owned")
        .agg(F.min("start").alias("start"), F.sum("size").alias("bytes"))
    )


def dedup_chunks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    mask_bits: int = MASK_BITS,
    max_chunk: int = MAX_CHUNK,
    min_run: int = MIN_RUN,
    keep_text: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_chunks, n_repeated, n_removed, n_short, repeated, removed``, sizes in bytes.

    ``n_short`` counts the bytes of repeated runs under ``min_run``. ``repeated`` has the spans ``(start, end)``, in bytes of the UTF-8 text, of runs that also occur elsewhere, first
    occurrences included; ``removed`` those of their chunks that an earlier occurrence owns. Spans hold whole characters.
    ``keep_text`` adds ``kept``, the text without ``removed``; the texts are then written once, for both passes.
    """
    own = numbered(docs, id_col, text_col)
    own = stage_table(own, "numbered") if keep_text else own
    table = stage_table(chunk_table(own, mask_bits, max_chunk), "chunks")
    whole = table.groupBy("row").agg(
        F.min("doc_id").alias("doc_id"),
        F.sum("size").cast("long").alias("n_bytes"),
        F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).cast("long").alias("n_chunks"),
    )
    whole = stage_table(whole, "documents")
    long = F.least(F.lit(min_run).cast("long"), F.col("n_bytes"))
    span = F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.col("bytes")).alias("end"))
    spans = (
        repeated_spans(table)
        .join(whole.select("row", "n_bytes"), "row")
        .groupBy("row", "run", "n_bytes")
        .agg(
            F.sum("bytes").alias("bytes"),
            F.min("start").alias("start"),
            F.collect_list(F.when(F.col("later") & (F.col("bytes") >= long), span)).alias("removed"),
        )
        .groupBy("row")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("bytes") >= long, span))).alias("repeated"),
            F.sort_array(F.flatten(F.collect_list(F.when(F.col("bytes") >= long, F.col("removed"))))).alias("removed"),
            F.sum(F.when(F.col("bytes") < long, F.col("bytes")).otherwise(0)).cast("long").alias("n_short"),
        )
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    found = whole.join(spans, "row", "left").withColumns({c: F.coalesce(c, none) for c in ("repeated", "removed")}).fillna(0, "n_short")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    names = ["doc_id", "n_bytes", "n_chunks", "n_repeated", "n_removed", "n_short", "repeated", "removed"]
    found = found.withColumns({f"n_{c}": total(c) for c in ("repeated", "removed")})
    if not keep_text:
        return found.select(*names)
    return found.join(own.select("row", "t"), "row").select(*names, F.udf(without, "string")("t", "removed").alias("kept"))


def without(text, spans):
    """``text`` without its byte ``spans``, which are in order."""
    data = text.encode()
    at = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[i:j] for i, j in zip(at[::2], at[1::2], strict=True)).decode()


def op9_chunk_dedup(spark, sf_dir):
    return dedup_chunks(read_documents(spark, sf_dir))
