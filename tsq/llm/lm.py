"""Language-model scoring by subword lattice likelihood.

The vocabulary is that of an existing tokenizer file (``vocabulary`` is its path); its pieces are never trained or extended.
A text is a sequence of pieces and an end, each drawn from one distribution, and its score is the base-10 logarithm of its
marginal probability: per word the forward recursion in log space over all segmentations of the word with its leading word
mark, plus the end. Characters without a piece take their byte pieces.

The scores in the file are ranks, not probabilities. A piece of rank r therefore starts with weight 1 / (r + 2.7), byte
pieces with that of the last rank; expectation maximisation over all training words then fits the weights: every
segmentation of a word counts by its probability and the word's occurrences.

The base model is a smoothed word count model. Counts cover all training texts; the ``TOP`` most frequent words of at most
``TOP_BYTES`` bytes (a bounded table) are broadcast, every other word is looked up by a join, so no count is left out.

Defined results: a null or empty text is just its end; null ids are training rows; repeated rows count each time; with no
training row the weights are the first ones, N and V are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsq.llm.common import drop_table, read_documents, stage_table, text_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MAX_PIECES = 1_000_000
ROUNDS = 3
SMOOTH = 0.05
TOP = 100_000
TOP_BYTES = 64
MAX_CACHE = 300_000
MARK = "▁"
END = "</s>"
LN10 = math.log(10)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    """Words with A-Z lowered; ``bytes.split`` parts at exactly space, tab, LF, VT, FF and CR."""
    return text.translate(_LOWER).split()


class Lattice:
    """Log weights of the pieces, and the recursions over a word's segmentations."""

    def __init__(self, weights: dict[str, float]):
        self.end = weights[END]
        self.log = {k: v for k, v in weights.items() if k != END}
        self.reach: dict[str, int] = {}
        for piece in self.log:
            if not piece.startswith("<0x"):
                self.reach[piece[0]] = max(self.reach.get(piece[0], 0), len(piece))

    def edges(self, word: str) -> list[list[tuple[int, float, list[str]]]]:
        """By end position: (start, log weight, pieces); a character without a piece is one edge of its bytes."""
        n = len(word)
        into: list[list[tuple[int, float, list[str]]]] = [[] for _ in range(n + 1)]
        for i, c in enumerate(word):
            for j in range(i + 1, min(n, i + self.reach.get(c, 0)) + 1):
                w = self.log.get(word[i:j])
                if w is not None:
                    into[j].append((i, w, [word[i:j]]))
            if c not in self.log:
                names = [f"<0x{b:02X}>" for b in c.encode()]
                into[i + 1].append((i, sum(self.log.get(x, -30.0) for x in names), names))
        return into

    def forward(self, word: str, into=None) -> list[float]:
        into = self.edges(word) if into is None else into
        alpha = [0.0]
        for j in range(1, len(word) + 1):
            terms = [alpha[i] + w for i, w, _ in into[j]]
            top = max(terms)
            alpha.append(top + math.log(sum([math.exp(t - top) for t in terms])))
        return alpha

    def log_prob(self, word: str) -> float:
        return self.forward(MARK + word)[-1]

    def expect(self, word: str, times: float, into_counts: dict[str, float]) -> None:
        """Adds the expected piece counts of ``times`` occurrences of a word."""
        word = MARK + word
        into = self.edges(word)
        alpha = self.forward(word, into)
        n, total = len(word), alpha[-1]
        beta = [-math.inf] * n + [0.0]
        for j in range(n, 0, -1):
            after = beta[j]
            for i, w, names in into[j]:
                here = w + after
                p = math.exp(alpha[i] + here - total) * times
                for x in names:
                    into_counts[x] = into_counts.get(x, 0.0) + p
                old = beta[i]
                beta[i] = here if old == -math.inf else max(old, here) + math.log1p(math.exp(-abs(old - here)))


def normalised(raw: dict[str, float], ends: float) -> dict[str, float]:
    """Logarithms of the shares of the pieces' weights and of the end's."""
    total = sum(raw.values()) + ends
    return {k: math.log(v / total) for k, v in raw.items()} | {END: math.log(ends / total)}


class Batch:
    """The same recursions for many words at once; words that are long or need byte pieces go to :class:`Lattice`."""

    LONGEST = 40
    BITS = 20
    PREFIX_BITS = 22

    def __init__(self, weights: dict[str, float]):
        self.slow = Lattice(weights)
        self.pieces = sorted(k for k in weights if k != END and not k.startswith("<0x"))
        self.log = np.array([*(weights[p] for p in self.pieces), -np.inf])
        self.keys = np.zeros(len(self.pieces) + 1, dtype=np.uint64)
        begun = set()
        for k, p in enumerate(self.pieces):
            h = 0
            for i, c in enumerate(p):
                h = (h * _BASE + _code(ord(c))) & _ALL
                if i < len(p) - 1:
                    begun.add(h)
            self.keys[k] = h
        self.begins = np.zeros(1 << self.PREFIX_BITS, dtype=bool)
        self.begins[self._slot(np.array(list(begun), dtype=np.uint64), 0, self.PREFIX_BITS)] = True
        self.tables = []
        left = np.arange(len(self.pieces))
        for turn in range(6):
            slot = self._slot(self.keys[left], turn, self.BITS)
            table = np.full(1 << self.BITS, len(self.pieces), dtype=np.int64)
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]
            if not len(left):
                break

    @staticmethod
    def _slot(h: np.ndarray, turn: int, bits: int) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93 + 2 * turn)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers by hash, the number of pieces where there is none."""
        none = len(self.pieces)
        out = np.full(len(h), none)
        for turn, table in enumerate(self.tables):
            k = table[self._slot(h, turn, self.BITS)]
            hit = (k < none) & (self.keys[k] == h)
            out[hit] = k[hit]
        return out

    def run(self, words: list[str], counts: np.ndarray | None = None, sums: dict[str, float] | None = None) -> np.ndarray:
        """Log probabilities; with ``counts`` the expected piece counts are added to ``sums`` by name."""
        out = np.zeros(len(words))
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        total = np.zeros(len(self.log)) if counts is not None else None
        slow = np.flatnonzero(size > self.LONGEST).tolist()
        for n in np.unique(size[size <= self.LONGEST]).tolist():
            which = np.flatnonzero(size == n)
            codes = np.frombuffer("".join([MARK + words[k] for k in which.tolist()]).encode("utf-32-le"), dtype=np.uint32).reshape(-1, n)
            m = np.ascontiguousarray(_code(codes.astype(np.uint64)).T)
            edges, plain = [], np.ones(len(which), dtype=bool)
            alpha = np.full((n + 1, len(which)), -np.inf)
            alpha[0] = 0.0
            for i in range(n):
                live, h = np.arange(len(which)), np.zeros(len(which), dtype=np.uint64)
                for j in range(i + 1, n + 1):
                    h = h * np.uint64(_BASE) + m[j - 1, live]
                    piece = self.find(h)
                    w = self.log[piece]
                    hit = w > -np.inf
                    if j == i + 1:
                        plain[live[~hit]] = False
                    rows = live[hit]
                    if len(rows):
                        edges.append((i, j, rows, piece[hit], w[hit]))
                        alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + w[hit])
                    # words in which no longer piece starts here fall away
                    on = self.begins[self._slot(h, 0, self.PREFIX_BITS)]
                    live, h = live[on], h[on]
                    if not len(live):
                        break
            out[which] = alpha[n]
            slow += which[~plain].tolist()
            if counts is None:
                continue
            beta = np.full((n + 1, len(which)), -np.inf)
            beta[n] = 0.0
            times = np.where(plain, counts[which], 0)
            for i, j, rows, piece, w in reversed(edges):
                here = w + beta[j, rows]
                p = np.exp(alpha[i, rows] + here - np.where(plain[rows], alpha[n, rows], np.inf)) * times[rows]
                total += np.bincount(piece, weights=p, minlength=len(total))
                beta[i, rows] = np.logaddexp(beta[i, rows], here)
        for k in slow:
            if counts is None:
                out[k] = self.slow.log_prob(words[k])
            else:
                self.slow.expect(words[k], float(counts[k]), sums)
        if counts is not None:
            for k in np.flatnonzero(total).tolist():
                sums[self.pieces[k]] = sums.get(self.pieces[k], 0.0) + float(total[k])
        return out


_BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def _code(c):
    """A code point's share of a hash, for an int or an array."""
    if isinstance(c, int):
        return (c + 1) * 0xD1B54A32D192ED03 & _ALL
    return (c + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)


def read_pieces(path: str) -> dict[str, float]:
    """First weights of the pieces of a vocabulary file, from the ranks that its scores are."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.vocab_size()
    if size > MAX_PIECES:
        raise ValueError(f"{path} has over {MAX_PIECES} pieces")
    raw = {}
    for i in range(size):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        piece = sp.id_to_piece(i)
        rank = size if sp.is_byte(i) else min(size, max(0.0, -sp.get_score(i)))
        if MARK not in piece[1:]:  # white space inside words does not occur
            raw[piece] = 1 / (rank + 2.7)
    return raw


def _held_out(id_col: str, folds: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def word_counts(train: DataFrame) -> DataFrame:
    """``(word, c)`` over the texts ``t``, counted on each task before the shuffle."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(split_words(t))
                if len(seen) > 500_000:
                    yield out()
                    seen.clear()
        yield out()

    return train.select("t").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit_weights(counts: DataFrame, ends: int, first: dict[str, float], rounds: int = ROUNDS) -> dict[str, float]:
    """EM over the training words and their counts; only sums by piece, whose number is fixed, come to the driver."""
    weights = normalised(first, 0.5)
    if not ends:
        return weights
    context = counts.sparkSession.sparkContext
    for _ in range(rounds):
        held = context.broadcast(weights)

        def run(batches, held=held):
            lattice, sums = Batch(held.value), {}
            for batch in batches:
                words = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
                lattice.run(words, batch.column(1).to_numpy().astype(float), sums)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.float64())], names=["piece", "e"])

        got = counts.select("word", "c").mapInArrow(run, "piece string, e double").groupBy("piece").agg(F.sum("e").alias("e")).toPandas()
        expected = dict(zip(got["piece"], got["e"], strict=True))
        weights = normalised({k: expected.get(k, 0.0) + SMOOTH for k in first}, ends + 0.5)
    return weights


def spell(df: DataFrame, weights) -> DataFrame:
    """Fills ``s``, the lattice's log probability of ``word``, where it is absent; equal words come together after a join
    or an aggregation by word, and each is worked out once a task."""
    rest = [c for c in df.columns if c not in ("word", "s")]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    df = df if "s" in kinds else df.withColumn("s", F.lit(None).cast("double"))

    def run(batches):
        lattice, seen = Batch(weights.value), {}
        for batch in batches:
            words = batch.column(0).to_pylist()
            s = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            void = np.flatnonzero(np.isnan(s))
            need = [words[k] for k in void.tolist()]
            fresh = list({w for w in need if w not in seen})
            if len(seen) + len(fresh) > MAX_CACHE:
                seen, fresh = {}, list(set(need))
            seen.update(zip(fresh, lattice.run([w.decode("utf-8", "replace") for w in fresh]).tolist(), strict=True))
            s[void] = [seen[w] for w in need]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), *batch.columns[2:]], names=["word", "s", *rest])

    schema = ", ".join(["word binary, s double", *[f"{c} {kinds[c]}" for c in rest]])
    return df.select("word", "s", *rest).mapInArrow(run, schema)


def often_edge(counts: DataFrame, top: int) -> int:
    """The smallest count bound under which at most ``top`` words lie, found on a bounded histogram; 0 if there is none."""
    steps = counts.groupBy(F.floor(F.log2("c") * 16).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect()
    edge, words = 0, 0
    for r in sorted(steps, key=lambda r: -r["b"]):
        words += r["n"]
        if words > top:
            break
        edge = r["c"]
    return edge


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, vocabulary: str = VOCABULARY, rounds: int = ROUNDS, top: int = TOP
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` by row; see the module."""
    context = docs.sparkSession.sparkContext
    own = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), _held_out(id_col, folds).alias("held_out"), text_of(text_col).alias("t")
    )
    counts = stage_table(word_counts(own.where(~F.col("held_out"))), "words")
    kinds, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    ends = docs.select(_held_out(id_col, folds).alias("h")).where(~F.col("h")).count()
    n, v = total + ends, kinds + (1 if ends else 0)
    scale = n + 0.1 * (v + 1)
    weights = context.broadcast(fit_weights(counts, ends, read_pieces(vocabulary), rounds))
    spelled = stage_table(spell(counts, weights), "spelled")
    drop_table(counts)
    short = F.length("word") <= TOP_BYTES
    edge = often_edge(spelled.where(short), top)
    often = spelled.where(short & (F.col("c") >= edge)).orderBy("word").toPandas() if edge else None
    held: tuple = ({}, np.zeros(1), np.zeros(1))
    if often is not None:
        c = often["c"].to_numpy(dtype=float)
        model = often["s"].to_numpy(dtype=float)
        held = ({bytes(w): k for k, w in enumerate(often["word"])}, np.append(np.log10((c + 0.1) / scale), 0.0), np.append(model, 0.0))
    known = context.broadcast(held)
    end = weights.value[END]
    del often, held

    def run(batches):
        at, base, model = known.value
        find = at.get
        for batch in batches:
            sizes, scores, bases, found, rare, times = [], [], [], [], [], []
            for t in batch.column(3).cast(pa.binary()).to_pylist():
                part = Counter(split_words(t))
                each = np.fromiter(part.values(), dtype=np.int64, count=len(part))
                which = np.fromiter(map(find, part, repeat(-1)), dtype=np.int64, count=len(part))
                hit = which >= 0
                sizes.append(int(each.sum()))
                found.append(int(each[hit].sum()))
                bases.append(float((base[which] * each).sum()))
                scores.append((float((model[which] * each).sum()) + end) / LN10)
                rare.append(list(compress(part, (~hit).tolist())))
                times.append(each[~hit].tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(sizes, pa.int64()),
                    pa.array(scores, pa.float64()),
                    pa.array(bases, pa.float64()),
                    pa.array(found, pa.int64()),
                    pa.array(rare, pa.list_(pa.binary())),
                    pa.array(times, pa.list_(pa.int32())),
                ],
                names=["row", "doc_id", "held_out", "n_words", "score", "base", "known", "rare", "times"],
            )

    schema = "row long, doc_id long, held_out boolean, n_words long, score double, base double, known long, rare array<binary>, times array<int>"
    scored = stage_table(own.mapInArrow(run, schema), "scored")
    rest = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    seldom = spelled.where(~short | (F.col("c") < edge)) if edge else spelled
    joined = spell(rest.join(seldom, "word", "left").select("word", "c", "s", "row", "k"), weights)
    c = F.coalesce(F.col("c"), F.lit(0))
    looked = joined.groupBy("row").agg(
        F.sum(F.col("k") * F.log10((c + 0.1) / scale)).alias("b"),
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("f"),
        F.sum(F.col("k") * F.col("s") / LN10).alias("m"),
    )
    end_base = math.log10((ends + 0.1) / scale)
    return scored.drop("rare", "times").join(looked, "row", "left").select(
        "doc_id",
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("f", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0)) + F.lit(end_base)).alias("base_score"),
        (F.col("score") + F.coalesce("m", F.lit(0.0))).alias("score"),
    )


def op5_lm_score(spark, sf_dir):
    return score_texts(read_documents(spark, sf_dir))
