"""Shared helpers: word pattern, document access, durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsq.llm.kernels import mix

#: A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``. Where it is unset, a temporary one in a local session, whose
    threads share this machine; a cluster has to name one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if re.match(r"local(?:\[|$)", spark.sparkContext.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tsq-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stage_table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tsq-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a :func:`stage_table` result that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(d)
        p.getFileSystem(conf).delete(p, True)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


PAGE_BITS = 1 << 16
MOST_BITS = 1 << 30
#: At least so many tasks put the pages together, and more once each would have more pages than this, 4 MB.
PAGE_TASKS = 8
TASK_PAGES = 512


def slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of 64-bit values in a bitmap of ``bits``, a power of two."""
    return (h & np.uint64(bits - 1)).astype(np.int64), (mix(h) & np.uint64(bits - 1)).astype(np.int64)


def holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a bitmap may hold each value; it never denies one that was put in."""
    out = np.ones(len(h), dtype=bool)
    for slot in slots(h, len(bitmap) * 8):
        out &= (bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
    return out


def bitmap_of(values: DataFrame, count: int) -> np.ndarray:
    """A packed bitmap of about 16 bits for each of ``count`` longs, 128 MB at most.

    It only sifts ahead of a join, so a full one costs time and changes no result. Its pages are put together on the
    executors, each in one task, and come to the driver once: a task's pages at a time, which takes a job, so their number
    goes by the pages and not by the partitions of the shuffle.
    """
    bits = 1 << 20
    while bits < min(16 * count, MOST_BITS):
        bits *= 2

    def place(batches):
        for batch in batches:
            at = np.concatenate(slots(batch.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at // PAGE_BITS).astype(np.int32)), pa.array((at % PAGE_BITS).astype(np.int32))], names=["page", "bit"])

    def build(batches):
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            page, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(page, kind="stable")
            page, bit = page[order], bit[order]
            cuts = np.flatnonzero(np.diff(page)) + 1
            if not len(page):
                continue
            for p, b in zip(page[np.concatenate([[0], cuts])].tolist(), np.split(bit, cuts), strict=True):
                pages.setdefault(p, np.zeros(PAGE_BITS, dtype=bool))[b] = True
        for p, b in pages.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(b).tobytes()], pa.binary())], names=["page", "b"])

    out = np.zeros((bits // PAGE_BITS, PAGE_BITS // 8), dtype=np.uint8)
    placed = values.mapInArrow(place, "page int, bit int").repartition("page").coalesce(max(PAGE_TASKS, len(out) // TASK_PAGES))
    for row in placed.mapInArrow(build, "page int, b binary").toLocalIterator():
        out[row["page"]] = np.frombuffer(row["b"], dtype=np.uint8)
    return out.ravel()
