"""A hierarchical Pitman-Yor language model of words in context, trained and applied over whole corpora.

The tokens of a text are drawn from restaurants by the word before them. The restaurants of the last level are the values of
20 bits of that word's hash; those that agree in 8 of the bits share a parent, all parents share the restaurant without context,
and its base is uniform over the distinct words of the training texts and one unknown type. Every customer sits at a table and
every table is a customer of the parent. What is gathered are the counts of (restaurant, word) cells: they grow with the corpus,
only the number of restaurants is fixed.

Seating is resampled by Gibbs sweeps over all customers: of a cell with c customers only the number t of its tables matters, and
given a gamma variate of the restaurant's tables and the parent's predictive probability, t has the weight S(c, t) a^t with
generalized Stirling numbers S, whatever the other cells hold. So t is drawn at once, whatever the count. Numbers S are exact up
to c = ``EXACT`` and by saddle point beyond. After ``BURN_IN`` sweeps predictive probabilities are averaged over ``SAMPLES`` more.

All cells of one word lie in one bucket (a hash of the word), at all levels, so a sweep needs no shuffle: between sweeps only the
customers and tables of each restaurant are summed (2.1 million numbers, whatever the corpus). The word's hash, the cell and the sweep seed each draw,
so scores do not depend on how rows are partitioned.

Texts are taken in blocks of up to ``BLOCK_BYTES``. A block's distinct cells are asked for once, packed by bucket; texts become
lists of places in them. Training counts and questions are the same rows, answers go back by block. What is shuffled follows the
distinct cells of blocks; a frequent word has at most as many cells a block as there are restaurants, so no bucket is hot.

A word that no training text has is the unknown type, as in the base score; as a context it counts like any other word.

Null and empty texts have one token, the end, which is also the context of a text's first word. A null key hashes as '' for the
fold. Repeated rows are scored alike and count as often as they occur. A text of any length is read whole and makes a block of its
own if it is longer than one. Ties do not arise. An empty table gives no rows; without training texts every word has the unknown
type's probability, 1. Only key and text are read; other columns may have any names.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwright.llm.common import delete, discard, fresh_path, release_shuffles, table, written

FOLDS, HELD_OUT = 7, 2
#: Bits of the context word's hash at each level, from the restaurant without context up; each level's bits begin the next one's.
BITS = (0, 8, 20)
#: Discount and strength of each level.
DISCOUNT = (0.6, 0.8, 0.9)
STRENGTH = (1.0, 1.0, 1.0)
BURN_IN, SAMPLES = 3, 3
#: Customers up to which Stirling numbers are tabled.
EXACT = 1024
SEED = 11
BLOCK_BYTES = 6 << 20
#: Answers are rounded to this part of a log10.
STEP = 1 / 2048
_PIECE = 1 << 15
_CELLS = 1 << BITS[-1]
#: Parts in which the restaurants' sums are added up.
_SLICES = 64
#: Counts of a bucket that are held before they are summed.
_PENDING = 1 << 22


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """Stirling's series from 256 on."""
    small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 256)))))
    x = np.maximum(n, 256).astype(float)
    return np.where(n < 256, small[np.minimum(n, 255)], x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3))


@functools.cache
def _means(d: float) -> tuple[np.ndarray, np.ndarray]:
    """log(1 - x), falling, and the log of the mean customers a table that x gives."""
    z = -np.geomspace(1e-9, 200.0, 4096)
    return z, np.log(d * np.expm1(z) / np.expm1(d * z)) + (d - 1) * z


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) from its generating function ((1 - (1 - x)^d) / d)^t / t!, without the factor of c alone."""
    grid, mean = _means(d)
    ratio = np.log(c / t)
    # z = log(1 - x) from a table, then by Newton's method.
    z = np.interp(ratio, mean, grid)
    for _ in range(2):
        e, ed = -np.expm1(z), -np.expm1(d * z)
        slope = d - 1 - np.exp(z) / e + d * np.exp(d * z) / ed
        z = np.clip(z - (np.log(d * e / ed) + (d - 1) * z - ratio) / np.minimum(slope, -1e-6), -200.0, -1e-9)
    x, f = -np.expm1(z), -np.expm1(d * z)
    mean = x * d * np.exp((d - 1) * z) / f
    spread = np.maximum(t * (mean + x * x * d * (1 - d) * np.exp((d - 2) * z) / f - mean**2), 1e-9)
    return t * np.log(f / d) - c * np.log(x) - 0.5 * np.log(spread) - _log_factorial(t)


@functools.cache
def _stirling(d: float) -> tuple[np.ndarray, np.ndarray]:
    """log S(c, t) up to ``EXACT``, and what to add to the saddle point for t up to half of it: its error depends on t and fades."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, c + 2)
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], out[c, 1 : c + 2] + np.log(np.maximum(c - d * t, 1e-300)))
    t = np.arange(1, EXACT // 2 + 1)
    off = out[EXACT, t] - _saddle(np.full(len(t), EXACT), t, d)
    return out, np.concatenate(([0.0], off - off[-1]))


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) but for a term of c alone."""
    exact, off = _stirling(d)
    out = np.where(t <= c, exact[np.minimum(c, EXACT), np.minimum(t, EXACT)], -np.inf)
    far = np.flatnonzero((c > EXACT) & (t <= c))
    out[far] = _saddle(c[far], t[far], d) + off[np.minimum(t[far], EXACT // 2)]
    return out


def draw_tables(c: np.ndarray, log_a: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """A number of tables for each cell of c customers, with probability in proportion to S(c, t) a^t, by the uniforms ``u``. What
    a cell draws does not depend on the cells beside it."""
    out = np.minimum(c, 1).astype(np.int64)
    order = np.argsort(c, kind="stable")
    order = order[c[order] > 1]
    at = 0
    while at < len(order):
        # Cells of similar counts at a time. Weights are log-concave in t: around the mode a stretch of 10 deviations is all.
        now = order[at : at + _PIECE]
        now = now[c[now] <= 2 * c[now[0]]]
        n, a = c[now].astype(np.int64), log_a[now]
        low, high = np.ones(len(now), np.int64), np.where(n > 64, n, 1)
        while (low < high).any():
            mid = (low + high) // 2
            up = log_stirling(n, np.minimum(mid + 1, n), d) - log_stirling(n, mid, d) + a > 0
            low, high = np.where(up & (low < high), mid + 1, low), np.where(up, high, mid)
        reach = np.where(n > 64, 10 * np.sqrt(low).astype(np.int64) + 12, n)
        first, last = np.maximum(low - reach, 1), np.minimum(low + reach, n)
        fit = max(1, (1 << 21) // (int((last - first).max()) + 1))
        now, n, a, first, last = now[:fit], n[:fit], a[:fit], first[:fit], last[:fit]
        width = int((last - first).max()) + 1
        t = first[:, None] + np.arange(width)
        w = log_stirling(np.repeat(n, width), t.ravel(), d).reshape(t.shape) + t * a[:, None]
        w = np.where(t <= last[:, None], w, -np.inf)
        w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
        out[now] = np.minimum(first + (w < u[now][:, None] * w[:, -1:]).sum(axis=1), last)
        at += len(now)
    return out


def uniforms(words: np.ndarray, context: np.ndarray | int, level: int, sweep: int, seed: int) -> np.ndarray:
    """A uniform number for each cell, from a 64-bit mix of the word's hash, the restaurant, the level and the sweep."""
    with np.errstate(over="ignore"):
        x = words ^ (np.uint64(0x9E3779B97F4A7C15) * (np.uint64(1) + np.asarray(context).astype(np.uint64) * np.uint64(64) + np.uint64(level)))
        x = x + np.uint64(0xD6E8FEB86659FD93) * np.uint64(1 + seed * 1024 + sweep)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


@dataclass
class Totals:
    """Customers and tables of every restaurant, level by level, and the distinct training words."""

    customers: list[np.ndarray]
    tables: list[np.ndarray]
    distinct: int

    def drawn(self, sweep: int, seed: int) -> list[np.ndarray]:
        """A gamma variate of each restaurant's tables."""
        rng = np.random.default_rng([seed, sweep])
        return [rng.gamma(STRENGTH[k] / DISCOUNT[k] + t) for k, t in enumerate(self.tables)]


class Seating:
    """All cells of some words. ``word`` and ``context`` of the last level's cells are sorted; level k's cell of cell i of level k+1
    is ``above[k][i]``."""

    def __init__(self, hashes: np.ndarray, word: np.ndarray, context: np.ndarray, customers: np.ndarray, tables: list[np.ndarray] | None = None):
        self.hashes = hashes
        words, contexts, self.above = [word], [context], []
        for k in range(len(BITS) - 2, -1, -1):
            size = 1 << BITS[k]
            keys, up = np.unique(words[0].astype(np.int64) * size + contexts[0] % size, return_inverse=True)
            words.insert(0, keys // size)
            contexts.insert(0, keys % size)
            self.above.insert(0, up)
        self.words, self.contexts = words, contexts
        self.customers = [customers.astype(np.int64)]
        self.tables = tables or []
        for k in range(len(BITS) - 1, -1, -1):
            if not tables:
                self.tables.insert(0, np.minimum(self.customers[0], 1))
            if k:
                self.customers.insert(0, self._sent(k, self.tables[k] if tables else self.tables[0]))

    def _sent(self, k: int, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.above[k - 1], tables, len(self.words[k - 1] if len(self.words) == len(BITS) else ())).astype(np.int64)

    def predictive(self, totals: Totals) -> list[np.ndarray]:
        """The probability of every cell's word in its restaurant, level by level."""
        out, base = [], np.full(len(self.words[0]), 1.0 / (totals.distinct + 1))
        for k in range(len(BITS)):
            if k:
                base = out[-1][self.above[k - 1]]
            at, d, s = self.contexts[k], DISCOUNT[k], STRENGTH[k]
            all_, opened = totals.customers[k][at], totals.tables[k][at]
            out.append((self.customers[k] - d * self.tables[k] + (s + d * opened) * base) / (s + all_))
        return out

    def sweep(self, totals: Totals, number: int, seed: int) -> None:
        """Seats all customers anew, from the last level down."""
        drawn, p = totals.drawn(number, seed), self.predictive(totals)
        for k in range(len(BITS) - 1, -1, -1):
            base = p[k - 1][self.above[k - 1]] if k else np.full(len(self.words[0]), 1.0 / (totals.distinct + 1))
            u = uniforms(self.hashes[self.words[k]], self.contexts[k], k, number, seed)
            self.tables[k] = draw_tables(self.customers[k], np.log(DISCOUNT[k] * drawn[k][self.contexts[k]] * base), DISCOUNT[k], u)
            if k:
                self.customers[k - 1] = self._sent(k, self.tables[k])

    def averaged(self, totals: Totals, first: int, samples: int, seed: int) -> np.ndarray:
        """The last level's probabilities, averaged over samples. A word without customers is the unknown type."""
        total = 0.0
        for i in range(samples):
            self.sweep(totals, first + i, seed)
            total = total + self.predictive(totals)[-1]
        return total / samples


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _packed(*parts) -> bytes:
    """Arrays of whole numbers from 0 on, in the least width that holds them, and byte strings as one compressed string."""

    def planes(x):
        """Bytes of equal weight side by side compress better."""
        if not isinstance(x, np.ndarray):
            return x
        narrow = np.ascontiguousarray(x.astype(np.min_scalar_type(int(x.max(initial=0)))))
        return narrow.dtype.str, narrow.view(np.uint8).reshape(-1, narrow.dtype.itemsize).T.tobytes()

    return zstandard.compress(pickle.dumps([planes(x) for x in parts], 5))


def _unpacked(raw: bytes) -> list:
    back = lambda kind, own: np.ascontiguousarray(np.frombuffer(own, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return [back(*x) if isinstance(x, tuple) else x for x in pickle.loads(zstandard.decompress(raw))]


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Block:
    """Texts of one block, the cells that they use, and the questions about them."""

    def __init__(self, texts: list[bytes | None], held: list[bool], buckets: int):
        ids: dict[bytes, int] = _Numbered()
        end = ids[b""]
        numbered = []
        for text in texts:
            words = (text or b"").lower().split()  # on bytes both touch ASCII only
            words.append(b"")
            numbered.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        self.words = list(ids)
        h = hashes_of(self.words)
        bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        context = (h & np.uint64(_CELLS - 1)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        tokens = np.concatenate(numbered)
        # Every text ends with the end, which is the context of the next one's first word.
        before = np.concatenate(([end], tokens[:-1]))
        sizes = np.fromiter(map(len, numbered), np.int64, len(numbered))
        cells, place = np.unique(rank[tokens] * _CELLS + context[before], return_inverse=True)
        counts = np.bincount(place, np.repeat(~np.asarray(held, bool), sizes), len(cells)).astype(np.int64)
        self.places = np.split(place.astype(np.uint32), np.cumsum(sizes)[:-1])
        del tokens, before, place, numbered
        self.questions = []
        found, first = np.unique(bucket[order], return_index=True)
        cut = np.searchsorted(cells, np.append(first, len(order)) * _CELLS)
        for i, b in enumerate(found.tolist()):
            part = slice(cut[i], cut[i + 1])
            stop = first[i + 1] if i + 1 < len(first) else len(order)
            own = [self.words[j] for j in order[first[i] : stop]]
            per = np.bincount(cells[part] // _CELLS - first[i], minlength=len(own))
            self.questions.append((b, _packed(b"\n".join(own), per, cells[part] % _CELLS, counts[part])))


class _Numbered(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _question(raw: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word of each cell, its context and its training count."""
    blob, per, context, counts = _unpacked(raw)
    return blob.split(b"\n"), np.repeat(np.arange(len(per)), per), context.astype(np.int64), counts.astype(np.int64)


def _blocks(kind: pa.DataType, buckets: int, block_bytes: int):
    """(key, held_out, text) to rows of texts (bucket null, payload: places) and of questions (bucket, payload)."""
    names = ["block", "bucket", "seq", "key", "held_out", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, keys, held, texts, size = 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            b = Block(texts, held, buckets)
            n, m = len(keys), len(b.questions)
            number = (TaskContext.get().partitionId() << 32) + made
            columns = [
                pa.array([number] * (n + m), pa.int64()), pa.array([None] * n + [q[0] for q in b.questions], pa.int32()), pa.array([*range(n), *[None] * m], pa.int64()),
                pa.array([*keys, *[None] * m], kind), pa.array([*held, *[None] * m], pa.bool_()), pa.array([_packed(x) for x in b.places] + [q[1] for q in b.questions], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for key, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if texts and size + len(text or b"") > block_bytes:
                    yield flush()
                    made, keys, held, texts, size = made + 1, [], [], [], 0
                keys.append(key)
                held.append(h)
                texts.append(text)
                size += len(text or b"")
        if texts:
            yield flush()

    return run


class _Counted:
    """Sums of the questions of one bucket; memory follows its distinct cells, not its blocks."""

    def __init__(self):
        self.ids, self.keys, self.counts, self.size = _Numbered(), [], [], 0

    def add(self, raw: bytes) -> None:
        words, at, context, counts = _question(raw)
        own = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        self.keys.append(own[at] * _CELLS + context)
        self.counts.append(counts)
        self.size += len(counts)
        if self.size > _PENDING and len(self.keys) > 2:
            self.sum()

    def sum(self) -> None:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.keys, self.counts = [keys], [np.bincount(at, np.concatenate(self.counts), len(keys)).astype(np.int64)]
        # Sums wait until as much again has come.
        self.size = -len(keys)

    def state(self) -> tuple[list[bytes], Seating]:
        self.sum()
        words = list(self.ids)
        return words, Seating(hashes_of(words), self.keys[0] // _CELLS, self.keys[0] % _CELLS, self.counts[0])


def _kept(words: list[bytes], s: Seating) -> bytes:
    known = int((np.bincount(s.words[-1], s.customers[-1], len(words)) > 0).sum())
    return _packed(known, b"\n".join(words), np.bincount(s.words[-1], minlength=len(words)), s.customers[-1], *s.contexts, *s.tables)


def _restored(raw: bytes) -> tuple[list[bytes], Seating]:
    _, blob, per, customers, *rest = _unpacked(raw)
    words, levels = blob.split(b"\n"), len(BITS)
    return words, Seating(hashes_of(words), np.repeat(np.arange(len(per)), per), rest[levels - 1].astype(np.int64), customers, [t.astype(np.int64) for t in rest[levels:]])


def _sums(raw: bytes) -> np.ndarray:
    """Customers of the last level's restaurants, tables of each level's, and the known words of one bucket."""
    known, _, _, customers, *rest = _unpacked(raw)
    contexts, tables = rest[: len(BITS)], rest[len(BITS) :]
    count = lambda k, n: np.bincount(contexts[k].astype(np.int64), n, 1 << BITS[k])
    return np.concatenate([count(-1, customers), *(count(k, tables[k]) for k in range(len(BITS))), [known]]).astype(np.int64)


_STATE = "bucket int, payload binary"


def _state_rows(rows: list[tuple[int, list[bytes], Seating]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in rows], pa.int32()), pa.array([_kept(w, s) for _, w, s in rows], pa.binary())], names=["bucket", "payload"])


def _first_seating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions, sorted by bucket, to the start: a table for every cell."""
    bucket, counted = None, None
    for batch in batches:
        for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if b != bucket:
                if counted:
                    yield _state_rows([(bucket, *counted.state())])
                bucket, counted = b, _Counted()
            counted.add(raw)
    if counted:
        yield _state_rows([(bucket, *counted.state())])


def _swept(totals, number: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, s = _restored(raw)
                s.sweep(totals.value, number, seed)
                yield _state_rows([(b, words, s)])

    return run


def _sliced(sums: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if sums is not None:
        parts = np.array_split(sums, _SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([_packed(p) for p in parts], pa.binary())], names=["slice", "payload"])


def _task_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's buckets, in slices."""
    sums = None
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            own = _sums(raw)
            sums = own if sums is None else sums + own
    yield from _sliced(sums)


def _slice_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of slices to one row a slice."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = _unpacked(raw)[0].astype(np.int64)
            sums[k] = sums[k] + own if k in sums else own
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_packed(x) for x in sums.values()], pa.binary())], names=["slice", "payload"])


def totals_of(state: DataFrame) -> Totals:
    """Sums over all buckets: added up within tasks, then slice by slice. What is collected is a number a restaurant and level, whatever
    the corpus."""
    kind = "slice int, payload binary"
    found = state.select("payload").mapInArrow(_task_sums, kind).repartition(_SLICES, "slice").mapInArrow(_slice_sums, kind).toArrow()
    sizes = [_CELLS, *(1 << b for b in BITS)]
    by = dict(zip(found["slice"].to_pylist(), found["payload"].to_pylist()))
    all_ = np.concatenate([_unpacked(by[k])[0].astype(np.int64) for k in range(_SLICES)]) if by else np.zeros(sum(sizes) + 1, np.int64)
    parts = np.split(all_, np.cumsum(sizes))
    customers, tables = [parts[0]], list(parts[1:-1])
    for k in range(len(BITS) - 1, 0, -1):
        customers.insert(0, np.bincount(np.arange(1 << BITS[k]) % (1 << BITS[k - 1]), tables[k], 1 << BITS[k - 1]).astype(np.int64))
    return Totals(customers, tables, int(parts[-1][0]))


def _answers(totals, first: int, samples: int, seed: int):
    """Rows sorted by bucket, its state before its questions, to (block, bucket, payload: the training counts of the
    question's words, how many cells each has, and the probabilities of the cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, counts, p = None, None, None, None
        for batch in batches:
            out = []
            for block, bucket, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if block is None:
                    words, s = _restored(raw)
                    ids = {w: i for i, w in enumerate(words)}
                    keys, counts = s.words[-1] * _CELLS + s.contexts[-1], np.bincount(s.words[-1], s.customers[-1], len(words)).astype(np.int64)
                    p = np.rint(-np.log10(s.averaged(totals.value, first, samples, seed)) / STEP).astype(np.int64)
                    del s, words
                    continue
                words, at, context, _ = _question(raw)
                own = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
                out.append((block, bucket, _packed(counts[own], np.bincount(at, minlength=len(own)), p[np.searchsorted(keys, own[at] * _CELLS + context)])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 3, (pa.int64(), pa.int32(), pa.binary()))], names=["block", "bucket", "payload"])

    return run


def _scored(tokens: int, distinct: int, key: str, kind: pa.DataType):
    """Rows sorted by block, its answers in order of their buckets before its texts, to scores."""
    floor = math.log10(tokens + distinct + 1)
    kinds = (kind, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, known = None, [], None
        for batch in batches:
            out = []
            for name, bucket, k, held, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if name != block:
                    block, parts, known = name, [], None
                if bucket is not None:
                    parts.append(_unpacked(raw))
                    continue
                if known is None:
                    c = np.concatenate([np.repeat(x[0], x[1]) for x in parts])
                    p = np.concatenate([x[2] for x in parts]) * -STEP
                    known, base, parts = c > 0, np.log10(c + 1.0) - floor, []
                at = _unpacked(raw)[0]
                out.append((k, held, len(at), int(known[at].sum()), tokens, float(base[at].sum()), float(p[at].sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, kinds)], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def perplexity(log10: float, n_tokens: int) -> float:
    return 10 ** (-log10 / max(1, n_tokens))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, burn_in: int = BURN_IN, samples: int = SAMPLES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score for each row."""
    context = docs.sparkSession.sparkContext
    source = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), F.col(text).cast("binary").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    arrow = _arrow_type(source)
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # A bucket holds about as many cells as a block.
    buckets = max(8, -(-size // block_bytes))
    # Blocks are named once, when they are written; all later passes read those names. Questions and texts lie apart.
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "blocks")
    schema = f"block bigint, bucket int, seq bigint, key {kind}, held_out boolean, payload binary"
    made = source.mapInArrow(_blocks(arrow, buckets, block_bytes), schema).withColumn("asked", F.col("bucket").isNotNull().cast("int"))
    made.write.option("compression", "zstd").partitionBy("asked").parquet(path)
    rows = spark.read.schema(f"{schema}, asked int").parquet(path)
    questions = rows.filter("asked = 1").select("block", "bucket", "payload")
    by_bucket = lambda df, *then: df.repartition(buckets, "bucket").sortWithinPartitions("bucket", *then)
    state = written(by_bucket(questions.select("bucket", "payload")).mapInArrow(_first_seating, _STATE), "seating")
    totals = totals_of(state)
    for number in range(burn_in):
        shared = context.broadcast(totals)
        before, state = state, written(state.mapInArrow(_swept(shared, number, seed), _STATE), "seating")
        shared.destroy()
        discard(before)
        totals = totals_of(state)
    release_shuffles(spark)
    tokens = int(totals.customers[-1].sum())
    asked = questions.unionByName(state.select(F.lit(None).cast("bigint").alias("block"), "bucket", "payload"))
    shared = context.broadcast(totals)
    answers = written(by_bucket(asked, F.col("block").asc_nulls_first()).mapInArrow(_answers(shared, burn_in, samples, seed), "block bigint, bucket int, payload binary"), "answers")
    shared.destroy()
    discard(state)
    delete(spark, f"{path}/asked=1")
    release_shuffles(spark)
    texts = rows.filter("asked = 0").select("block", "bucket", "seq", "key", "held_out", "payload")
    both = texts.unionByName(answers, allowMissingColumns=True).repartition(buckets, "block").sortWithinPartitions("block", F.col("bucket").asc_nulls_last(), "seq")
    body = _scored(tokens, totals.distinct, key, arrow)
    return both.select("block", "bucket", "key", "held_out", "payload").mapInArrow(body, f"`{key}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _arrow_type(source: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(source.schema["key"].dataType)


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
