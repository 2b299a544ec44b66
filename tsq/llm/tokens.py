"""Edit-aware token counts: a segment tree of pre-tokens per document, re-encoded only where edits touch it.

A byte-level BPE splits a text into pre-tokens by a pattern and encodes each by itself, so a text's count is the sum over
its pre-tokens. A document keeps leaves of about ``LEAF`` pre-tokens (code points, tokens) under a heap of subtree sums.
An edit descends to the leaf it hits, starts at a leaf boundary at least ``REACH`` characters before it (the pattern
looks no further past a match), splits the new text from there until a boundary falls on an old leaf boundary behind the
edit, encodes that stretch alone, and updates the sums on the paths above it. All else keeps its counts, because a
match depends only on the text that follows its start.

The vocabulary is an existing rank file, read on the driver (``vocabulary`` is its path) and broadcast; its size is
bounded by ``MAX_VOCABULARY_BYTES``. Nothing is trained.

Defined results: a null text is empty and has 0 tokens; null edits are none; edits apply in order, their places refer to
the text as it then is and are clipped to it; repeated rows and null ids are counted row by row; an empty table gives
no rows; other input columns are kept, but for those named like the operator's own, in any case, which it replaces.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsq.llm.common import read_documents, text_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 64 << 20
LEAF = 32
REACH = 3
MAX_CACHE = 400_000

# Fixed value: the split pattern that the rank file was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counts(dict):
    """Tokens by pre-token, encoded at first sight; it is emptied when it has grown to ``MAX_CACHE`` entries."""

    def __init__(self, raw: bytes, pattern: str = PATTERN):
        super().__init__()
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        if len(self) >= MAX_CACHE:
            self.clear()
        n = len(self.encoding._encode_single_piece(piece.encode()))
        if len(piece) <= 64:
            self[piece] = n
        return n


_counts: dict[int, Counts] = {}


def counts_for(held) -> Counts:
    """This worker's counter for a broadcast vocabulary."""
    raw = held.value
    key = hash(raw)
    if key not in _counts:
        _counts.clear()
        _counts[key] = Counts(raw)
    return _counts[key]


def load_vocabulary(spark: SparkSession, path: str = VOCABULARY):
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is over {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(raw)


def heap_of(leaves: np.ndarray) -> np.ndarray:
    """Subtree sums: node 1 is the root, node k has children 2k and 2k + 1, the leaves are the second half."""
    half = 1 << max(0, int(len(leaves) - 1).bit_length())
    heap = np.zeros(2 * half, dtype=np.int64)
    heap[half : half + len(leaves)] = leaves
    while half > 1:
        heap[half // 2 : half] = heap[half : 2 * half].reshape(-1, 2).sum(axis=1)
        half //= 2
    return heap


class Tree:
    """Heaps of code points and tokens over the leaves of one text."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens

    @classmethod
    def build(cls, text: str, counts: Counts) -> tuple[Tree, int]:
        pieces = counts.pattern.findall(text)
        if not pieces:
            return cls(heap_of(np.zeros(1, np.int64)), heap_of(np.zeros(1, np.int64))), 0
        at = np.arange(0, len(pieces), LEAF)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        n = np.fromiter(map(counts.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        return cls(heap_of(np.add.reduceat(size, at)), heap_of(np.add.reduceat(n, at))), len(pieces)

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, first code point of it) of the leaf that holds ``place``."""
        half, k, start = len(self.chars) // 2, 1, 0
        while k < half:
            k *= 2
            left = int(self.chars[k])
            if place - start >= left:
                start += left
                k += 1
        return k - half, start

    def edit(self, text: str, start: int, end: int, put: str, counts: Counts) -> tuple[str, int]:
        """The edited text and the number of code points that were encoded again."""
        n = len(text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        new, shift = text[:start] + put + text[end:], len(put) - (end - start)
        first, at = self.find(max(0, start - REACH))
        last, old_end = first, at
        half = len(self.chars) // 2
        pieces, t = [], at
        for m in counts.pattern.finditer(new, at):
            pieces.append(m[0])
            t = m.end()
            if t < start + len(put):
                continue
            while last < half and old_end + shift < t:
                old_end += int(self.chars[half + last])
                last += 1
            if last > first and old_end >= end and old_end + shift == t:
                break
        if t == len(new):
            last = half
        last = max(last, first + 1)
        slots = last - first
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        n_tokens = np.fromiter(map(counts.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        if len(pieces) > 4 * LEAF * slots:  # the leaves would grow too large: a new heap over old and new sums
            cut = np.arange(0, len(pieces), LEAF)
            for name, own in (("chars", size), ("tokens", n_tokens)):
                leaves = getattr(self, name)[half:]
                setattr(self, name, heap_of(np.concatenate([leaves[:first], np.add.reduceat(own, cut), leaves[last:]])))
            return new, int(size.sum())
        share = -(-len(pieces) // LEAF) or 1
        share = min(slots, share)
        which = np.minimum(np.arange(len(pieces)) * share // max(1, len(pieces)), share - 1)
        for heap, own in ((self.chars, size), (self.tokens, n_tokens)):
            heap[half + first : half + last] = np.bincount(which, weights=own, minlength=slots).astype(np.int64)[:slots]
            lo, hi = (half + first) // 2, (half + last - 1) // 2
            while lo >= 1:
                heap[lo : hi + 1] = heap[2 * lo : 2 * hi + 2].reshape(-1, 2).sum(axis=1)
                lo, hi = lo // 2, hi // 2
        return new, int(size.sum())


_TREE = "tree_chars array<long>, tree_tokens array<long>, n_pretokens long"


def _with_columns(batch: pa.RecordBatch, arrays: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])


def _without(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])


def build_trees(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with their trees: ``tree_chars`` and ``tree_tokens`` are heaps, entry 1 the document's total."""
    held = load_vocabulary(docs.sparkSession, vocabulary)
    own = ["tree_chars", "tree_tokens", "n_pretokens"]
    docs = _without(docs, own)
    place = docs.columns.index(text_col)

    def run(batches):
        counts = counts_for(held)
        for batch in batches:
            built = [Tree.build(t or "", counts) for t in batch.column(place).to_pylist()]
            yield _with_columns(
                batch,
                [pa.array([x.chars for x, _ in built], pa.list_(pa.int64())), pa.array([x.tokens for x, _ in built], pa.list_(pa.int64())), pa.array([n for _, n in built], pa.int64())],
                own,
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + _TREE
    return docs.mapInArrow(run, schema)


def apply_edits(trees: DataFrame, edits_col: str, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Applies ``edits_col`` (array of struct of start, end, put): new text and trees, and ``reencoded`` code points."""
    held = load_vocabulary(trees.sparkSession, vocabulary)
    trees = _without(trees, ["reencoded"])
    names = trees.columns
    at = {c: names.index(c) for c in (text_col, edits_col, "tree_chars", "tree_tokens")}

    def run(batches):
        counts = counts_for(held)
        for batch in batches:
            texts, chars, tokens, again = [], [], [], []
            for text, edits, c, k in zip(*(batch.column(i) for i in at.values()), strict=True):
                text, done = text.as_py() or "", 0
                tree = Tree(np.array(c.values, dtype=np.int64), np.array(k.values, dtype=np.int64))
                for edit in edits.as_py() or ():
                    text, n = tree.edit(text, edit["start"], edit["end"], edit["put"] or "", counts)
                    done += n
                texts.append(text)
                chars.append(tree.chars)
                tokens.append(tree.tokens)
                again.append(done)
            new = {text_col: pa.array(texts, pa.string()), "tree_chars": pa.array(chars, pa.list_(pa.int64())), "tree_tokens": pa.array(tokens, pa.list_(pa.int64()))}
            arrays = [new.get(name, batch.column(i)) for i, name in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(again, pa.int64())], names=[*names, "reencoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trees.schema) + ", reencoded long"
    return trees.mapInArrow(run, schema)


def op10_token_counts(spark, sf_dir):
    """Counts of every whole text, and again after two edits a text: a replacement at a third, an insertion at two thirds."""
    docs = read_documents(spark, sf_dir).select("doc_id", text_of().alias("text"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edits = F.array(
        F.struct(third.alias("start"), (third + 8).alias("end"), F.lit("edit").alias("put")),
        F.struct((third * 2).alias("start"), (third * 2).alias("end"), F.lit(" and so on").alias("put")),
    )
    built = build_trees(docs.withColumn("edits", edits)).withColumn("n_tokens", F.col("tree_tokens")[1])
    return apply_edits(built, "edits").select(
        "doc_id", "n_pretokens", "n_tokens", F.col("tree_tokens")[1].alias("edited_tokens"), F.col("tree_chars")[1].alias("edited_chars"), "reencoded"
    )
