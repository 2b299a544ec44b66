"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal updates.

Tokens are runs of letters and digits or runs of other ink, lower-cased over A-Z; each token and each pair of neighbours
inside a text is hashed to one of ``2**bits`` weights. A feature's value is its share of the text's tokens (square root,
to damp repeats), so texts of any length are comparable. Scores are sparse dot products over whole texts.

Only the fit reads labels, and only of rows whose crc32(id as text) mod ``folds`` is not ``held``. It is made on at most
``max_rows`` labelled rows, those with the smallest hash of the id, so the choice does not depend on the partitioning.
The fit runs in one task over that bounded sample; the weights have a fixed size (``2**bits`` doubles) and are broadcast.

Defined results: a null text is empty, has no tokens and is scored by the bias; null ids are held out of the fit; repeated
ids are scored row by row and a repeated label is one example each time; without labelled rows every score is 0.5; an
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsq.llm.common import read_documents, text_of
from tsq.llm.kernels import mix, runs, span_hashes, text_buffer

BITS = 18
MAX_ROWS = 6000
EPOCHS = 3
_U = np.uint64

#: Every pair of equal neighbours also counts here, whatever the word.
_TWICE = mix(np.array([0x7477696365], dtype=np.uint64))[0]
#: Byte classes: 0 white space, 1 letters, digits and all bytes of non-ASCII characters, 2 other ink.
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[128:] = 1
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _CLASS[_a:_b] = 1
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, slot, value): distinct hashed unigrams and bigrams by document."""
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    change = np.ones(len(data), dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    starts = np.flatnonzero((kind > 0) & (change | edge[:-1]))
    stop = np.ones(len(data), dtype=bool)
    stop[:-1] = change[1:] if len(data) else stop[:-1]
    ends = np.flatnonzero((kind > 0) & (stop | edge[1:])) + 1
    word = span_hashes(_FOLD[data], starts, ends)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    n = len(offsets) - 1
    pair = mix(word[:-1] * _U(0x9E3779B97F4A7C15) + word[1:])
    inside = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, dtype=bool)
    same = inside & (word[1:] == word[:-1])
    twice = np.full(int(same.sum()), _TWICE)
    slot = (np.concatenate([word, pair[inside], twice]) >> _U(64 - bits)).astype(np.int64)
    owner = np.concatenate([doc, doc[1:][inside], doc[1:][same]])
    key, count = np.unique((owner << bits) | slot, return_counts=True)
    owner, slot = key >> bits, key & ((1 << bits) - 1)
    tokens = np.maximum(np.bincount(doc, minlength=n), 1)
    return owner, slot, np.sqrt(count / tokens[owner])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
    """FTRL-proximal weights (the last one is the bias) of (slots, values, label) examples, classes weighed evenly."""
    size = (1 << bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    labels = np.array([r[2] for r in rows], dtype=float)
    if not len(rows):
        return w
    good = labels.mean()
    weigh = {1: 0.5 / max(good, 1e-9), 0: 0.5 / max(1 - good, 1e-9)} if 0 < good < 1 else {0: 1.0, 1: 1.0}
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            slot, value, label = rows[k]
            slot, value = np.append(slot, size - 1), np.append(value, 1.0)
            zi, ni = z[slot], n[slot]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(wi @ value, -35, 35)))
            g = (p - label) * value * weigh[label]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[slot] = zi + g - sigma * wi
            n[slot] = ni + g * g
    live = np.abs(z) > l1
    w[live] = -(z[live] - np.sign(z[live]) * l1) / ((beta + np.sqrt(n[live])) / alpha + l2)
    return w


def held_out(id_col: str, folds: int, held: int) -> Column:
    """Whether crc32(id as text) mod ``folds`` is ``held``; true for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held: int, bits: int, max_rows: int) -> np.ndarray:
    """The weights, from one task over the bounded sample."""
    order = F.xxhash64(F.col("id"), F.lit(11))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1)).where(~held_out("id", folds, held))
    chosen = known.orderBy(order, "id", "y").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    sample = texts.join(F.broadcast(chosen), "id").select("id", "y", "t")

    def digest(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for i, j, part, at in runs(data, offsets):
                owner, slot, value = features(part, at, bits)
                cut = np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(cut), pa.array(slot)), pa.ListArray.from_arrays(pa.array(cut), pa.array(value))],
                    names=["id", "y", "slot", "value"],
                )

    def learn(batches):
        rows = []
        for batch in batches:
            for i, y, s, v in zip(*batch.columns, strict=True):
                rows.append((i.as_py(), np.asarray(s.values, dtype=np.int64), np.asarray(v.values), y.as_py()))
        rows.sort(key=lambda r: (r[0], len(r[1]), r[3]))
        w = train([r[1:] for r in rows], bits)
        live = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(w[live])], names=["slot", "w"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    examples = sample.mapInArrow(digest, f"id {kind}, y int, slot array<long>, value array<double>")
    got = examples.repartition(1).mapInArrow(learn, "slot long, w double").toPandas()
    w = np.zeros((1 << bits) + 1)
    w[got["slot"].to_numpy(dtype=np.int64)] = got["w"].to_numpy(dtype=float)
    return w


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 4,
    held: int = 2,
    threshold: float = 0.7,
    bits: int = BITS,
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` by row."""
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, folds, held, bits, max_rows))
    own = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, folds, held).alias("held_out"), text_of(text_col).alias("t"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches):
        w = weights.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            score = np.full(batch.num_rows, w[-1])
            for i, j, part, at in runs(data, offsets):
                owner, slot, value = features(part, at, bits)
                score[i:j] += np.bincount(owner, weights=w[slot] * value, minlength=j - i)
            score = 1 / (1 + np.exp(-np.clip(score, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return own.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op4_quality_score(spark, sf_dir):
    return score_quality(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
