"""Benchmark decontamination by the q-gram lemma.

Texts are normalised (white-space runs to one space, simple lower case). Each benchmark item is covered by windows of
``window`` characters, ``window / 2`` apart, the last one flush with its end; an item shorter than that is one window.
A document leaks an item if some window occurs in it with at most ``floor(rate * length)`` edits. Such an occurrence
shares at least ``length + 1 - q * (edits + 1)`` character q-grams inside one diagonal band, so q-gram hits are counted
in overlapping bands of diagonals, bands below the bound are discarded, and the rest are verified by a banded
edit-distance alignment with free ends in the document. The filter loses nothing.

Hits are expanded for stretches of positions that have at most about ``HITS`` of them, each stretch overlapping the one
before by more than a band's reach, so memory does not grow with a text's repetitions. In a text of several stretches a
window that was found without edits is not looked for again: no later place can be better.

The benchmark is the stated query set: it is read in blocks of at most ``block_chars`` characters, each block's index
is broadcast under that bound, and every block is held against all documents, whole. Documents are never shuffled.

Defined results: null or empty texts leak nothing; items shorter than ``q`` normalised characters are not searched
(chance hits); repeated documents or items give their rows each time; null ids stay null; an empty table on either
side gives no leaks; other columns are ignored by :func:`find_leaks` and kept by :func:`drop_leaks`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsq.llm.common import read_documents, text_of
from tsq.llm.kernels import powers, runs, text_buffer

Q = 12
WINDOW = 64
RATE = 0.06
BAND = 16
BLOCK_CHARS = 2_000_000
HITS = 1_000_000

_U = np.uint64
_TABLE_BITS = 20
_LOWER = np.arange(0x600, dtype=np.uint32)
for _c in range(0x600):
    if len(chr(_c).lower()) == 1:
        _LOWER[_c] = ord(chr(_c).lower())


def normalise(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised code points, the new bounds, and each one's place in ``codes``."""
    low = np.where(codes < len(_LOWER), _LOWER[np.minimum(codes, len(_LOWER) - 1)], codes)
    space = (low == 0x20) | ((low >= 9) & (low <= 13))
    low = np.where(space, np.uint32(0x20), low)
    again = np.zeros(len(low), dtype=bool)
    again[1:] = space[1:] & space[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(low))]
    again[inner] = False
    at = np.flatnonzero(~again)
    return low[at], np.searchsorted(at, bounds), at


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    return codes, lead[offsets]


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=_U)
    np.cumsum((codes.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019)) * up[:-1], out=total[1:])
    return (total[q:] - total[:-q]) * down[:n]


class Index:
    """Windows of one block of items and the postings of their q-grams."""

    def __init__(self, items: list[tuple[object, str]], q: int = Q, window: int = WINDOW, rate: float = RATE, hits: int = HITS):
        self.hits, self.q, self.ids, self.item, self.windows, self.edits = hits, q, [i for i, _ in items], [], [], []
        for k, (_, text) in enumerate(items):
            raw = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            codes, _, _ = normalise(raw, np.array([0, len(raw)]))
            codes = codes[1:] if len(codes) and codes[0] == 0x20 else codes
            codes = codes[:-1] if len(codes) and codes[-1] == 0x20 else codes
            if len(codes) < q:
                continue
            size = min(window, len(codes))
            for s in dict.fromkeys([*range(0, len(codes) - size + 1, max(1, size // 2)), len(codes) - size]):
                self.item.append(k)
                self.windows.append(codes[s : s + size])
                edits = int(rate * size)
                while size + 1 - q * (edits + 1) < 1:
                    edits -= 1
                self.edits.append(edits)
        self.item, self.edits = np.array(self.item, dtype=np.int64), np.array(self.edits, dtype=np.int64)
        self.sizes = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.shift = (int(self.sizes.max(initial=0)) // BAND + 2) * BAND
        self.bound = self.sizes + 1 - q * (self.edits + 1)
        grams = [gram_hashes(w, q) for w in self.windows]
        h = np.concatenate(grams) if grams else np.zeros(0, dtype=_U)
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, dtype=np.int64)
        of = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.zeros(0, dtype=np.int64)
        order = np.argsort(h, kind="stable")
        self.gram, first = np.unique(h[order], return_index=True)
        self.post = np.append(first, len(h))
        self.post_window, self.post_at = of[order], at[order]
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[self._slot(self.gram)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * _U(0xD6E8FEB86659FD93)) >> _U(64 - _TABLE_BITS)).astype(np.int64)

    def search(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(doc, window, start, end, edits) of verified occurrences in normalised documents, by band; some come twice."""
        none = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
        h = gram_hashes(codes, self.q)
        pos = np.flatnonzero(self.table[self._slot(h)]) if len(h) and len(self.gram) else np.zeros(0, dtype=np.int64)
        if not len(pos):
            return none
        g = np.minimum(np.searchsorted(self.gram, h[pos]), len(self.gram) - 1)
        real = self.gram[g] == h[pos]
        pos, g = pos[real], g[real]
        doc = np.searchsorted(bounds, pos, side="right") - 1
        whole = pos + self.q <= bounds[doc + 1]
        pos, g, doc = pos[whole], g[whole], doc[whole]
        cost = np.concatenate([[0], np.cumsum(self.post[g + 1] - self.post[g])])
        edge = np.searchsorted(pos, bounds)
        found, k, n = [], 0, len(bounds) - 1
        while k < n:
            j = int(np.searchsorted(cost[edge], cost[edge[k]] + self.hits, side="right")) - 1
            if j > k:
                found.append(self._occurrences(codes, bounds, *(x[edge[k] : edge[j]] for x in (pos, g, doc))))
            else:
                j = k + 1
                found += self._in_stretches(codes, bounds, *(x[edge[k] : edge[j]] for x in (pos, g, doc)))
            k = j
        found = [x for x in found if len(x[0])]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else none

    def _in_stretches(self, codes, bounds, pos, g, doc):
        """The occurrences in one document, stretch by stretch."""
        reach = int(self.sizes.max()) + BAND + 2 * int(self.edits.max()) + self.q
        wanted = np.ones(len(self.post_window), dtype=bool)
        open_ = np.ones(len(self.sizes), dtype=bool)
        out, i = [], 0
        while i < len(pos):
            share = np.add.reduceat(wanted.astype(np.int64), self.post[:-1])[g[i:]]
            if not share.any():
                break
            total = np.cumsum(share)
            j = i + max(1, int(np.searchsorted(total, self.hits, side="right")))
            # a stretch goes on beyond what the next one starts again with
            j = max(j, int(np.searchsorted(pos, pos[i] + 2 * reach)))
            hit = self._occurrences(codes, bounds, pos[i:j], g[i:j], doc[i:j], wanted)
            out.append(hit)
            done = hit[1][hit[4] == 0]
            if len(done):
                open_[done] = False
                wanted = open_[self.post_window]
            if j >= len(pos):
                break
            i = max(i + 1, int(np.searchsorted(pos, pos[j - 1] - reach)))
        return out

    def _occurrences(self, codes, bounds, pos, g, doc, wanted=None):
        many = self.post[g + 1] - self.post[g]
        rep = np.repeat(np.arange(len(pos)), many)
        p = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many) + self.post[g][rep]
        if wanted is not None:
            rep, p = rep[wanted[p]], p[wanted[p]]
        win, place = self.post_window[p], pos[rep]
        diag = place - self.post_at[p] - bounds[doc[rep]] + self.shift
        band = diag // BAND
        extra = (diag - (band - 1) * BAND) < BAND + self.edits[win]
        win = np.concatenate([win, win[extra]])
        place = np.concatenate([place, place[extra]])
        d = np.concatenate([doc[rep], doc[rep][extra]])
        band = np.concatenate([band, band[extra] - 1])
        order = np.lexsort((place, band, win, d))
        win, place, d, band = win[order], place[order], d[order], band[order]
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (win[1:] != win[:-1]) | (band[1:] != band[:-1])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(d)))
        keep = start[count >= self.bound[win[start]]]
        if not len(keep):
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
        return self._verify(codes, bounds, d[keep], win[keep], (band[keep] * BAND) - self.shift)

    def _verify(self, codes, bounds, doc, win, diag):
        """Banded alignment of each window at diagonals ``[diag, diag + BAND + edits)``, ends in the document free."""
        found = []
        for at in range(0, len(doc), 4096):
            d, w, g = doc[at : at + 4096], win[at : at + 4096], diag[at : at + 4096]
            e = int(self.edits[w].max())
            lo = g - e
            width = BAND + 3 * e + 1
            lanes = np.arange(width)
            big = 1 << 20
            origin = lo[:, None] + lanes
            inside = (origin >= 0) & (origin <= (bounds[d + 1] - bounds[d])[:, None])
            best_cost = np.where(inside, 0, big)
            best_from = origin.copy()
            sizes, length = self.sizes[w], (bounds[d + 1] - bounds[d])[:, None]
            size_max = int(sizes.max())
            text = np.zeros((len(d), size_max), dtype=np.uint32)
            for k, x in enumerate(w):
                text[k, : self.sizes[x]] = self.windows[x]
            done_cost = np.full((len(d), width), big)
            done_from = np.zeros((len(d), width), dtype=np.int64)
            for i in range(size_max):
                j = lo[:, None] + lanes + i  # document position read by a diagonal step
                ok = (j >= 0) & (j < length)
                char = codes[np.clip(bounds[d][:, None] + j, 0, len(codes) - 1)]
                step = best_cost + np.where(ok & (char == text[:, i : i + 1]), 0, 1)
                step = np.where(ok, step, big)
                skip = np.full_like(step, big)  # a window character without a partner: the lane to the right, one row up
                skip[:, :-1] = best_cost[:, 1:] + 1
                src = np.where(skip < step, 1, 0)
                cur = np.where(src == 1, skip, step)
                frm = best_from.copy()
                frm[:, :-1] = np.where(src[:, :-1] == 1, best_from[:, 1:], best_from[:, :-1])
                end = j + 1
                cur = np.where((end >= 0) & (end <= length), cur, big)
                for x in range(1, width):  # a document character without a partner
                    better = cur[:, x - 1] + 1 < cur[:, x]
                    better &= (end[:, x] >= 0) & (end[:, x] <= length[:, 0])
                    cur[:, x] = np.where(better, cur[:, x - 1] + 1, cur[:, x])
                    frm[:, x] = np.where(better, frm[:, x - 1], frm[:, x])
                best_cost, best_from = cur, frm
                over = sizes == i + 1
                done_cost[over], done_from[over] = cur[over], frm[over]
            lane = done_cost.argmin(axis=1)
            row = np.arange(len(d))
            edits = done_cost[row, lane]
            good = edits <= self.edits[w]
            end = lo + lane + sizes
            found.append((d[good], w[good], done_from[row, lane][good], end[good], edits[good]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def leaks_of(index: Index, column: pa.Array) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item, start, end, edits, windows) by row and item: the occurrence with fewest edits, then the first."""
    data, offsets = text_buffer(column)
    for first, _, part, bounds in runs(data, offsets):
        codes, at = code_points(part, bounds)
        plain, where, place = normalise(codes, at)
        doc, win, start, end, edits = index.search(plain, where)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        windows: dict[tuple[int, int], set[int]] = {}
        for d, w, s, e, k in zip(doc.tolist(), win.tolist(), start.tolist(), end.tolist(), edits.tolist(), strict=True):
            key = (d, int(index.item[w]))
            base = int(where[d])
            span = (k, int(place[base + s] - at[d]), int(place[base + e - 1] + 1 - at[d]))
            best[key] = min(best.get(key, span), span)
            windows.setdefault(key, set()).add(w)
        for (d, item), (k, s, e) in sorted(best.items()):
            yield first + d, item, s, e, k, len(windows[d, item])


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of at most ``block_chars`` characters, or of one longer item."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).alias("i"), text_of(text_col).alias("t")).toLocalIterator():
        if block and size + len(row["t"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += len(row["t"])
    if block:
        yield block


def _each_block(benchmark: DataFrame, item_col: str, item_text: str, block_chars: int, params: dict):
    context = benchmark.sparkSession.sparkContext
    for block in blocks(benchmark, item_col, item_text, block_chars):
        yield context.broadcast(Index(block, **params))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
    **params,
) -> DataFrame:
    """One row per leaked (document, item): ``doc_id, item_id, start, end, edits, windows``; places in code points."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    schema = "doc_id long, item_id long, start long, end long, edits long, windows long"
    names = ["doc_id", "item_id", "start", "end", "edits", "windows"]

    def searcher(held):
        def run(batches):
            for batch in batches:
                rows = list(leaks_of(held.value, batch.column(1)))
                ids, items = batch.column(0), held.value.ids
                table = [
                    ids.take(pa.array([r[0] for r in rows], type=pa.int64())),
                    pa.array([items[r[1]] for r in rows], type=pa.int64()),
                    *[pa.array([r[k] for r in rows], type=pa.int64()) for k in range(2, 6)],
                ]
                yield pa.RecordBatch.from_arrays(table, names=names)

        return run

    out = None
    for held in _each_block(benchmark, item_col, item_text, block_chars, params):
        part = own.mapInArrow(searcher(held), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
    **params,
) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    place = docs.columns.index(text_col)

    def keeper(held):
        def run(batches):
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[r[0] for r in leaks_of(held.value, batch.column(place))]] = False
                yield batch.filter(pa.array(clean))

        return run

    out = docs
    for held in _each_block(benchmark, item_col, item_text, block_chars, params):
        out = out.mapInArrow(keeper(held), docs.schema)
    return out


def op1_decontaminate(spark, sf_dir):
    return find_leaks(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
