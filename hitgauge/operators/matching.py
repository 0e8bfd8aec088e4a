"""Exact nearest cached entry (or k entries) by cosine similarity.

Three plans give the same rows; which one runs follows from the measured sizes:

* the cache is small: it is broadcast and every query finds its matches in a map-only pass;
* the queries are few (a sample against a whole log): they are broadcast, the cache is scanned
  once without a shuffle, each task keeps its best k per query and an aggregate merges the tasks;
* both sides are large: each is dealt into parts by a hash of its id, so no key, source or group of copies makes
  a part larger than another, and packed into blocks. Every pair of parts is one task of a Cartesian product, which reads
  the parts again instead of copying them: each vector is written once, however many tasks there are. A task holds
  a bounded part of the cache and sees one pair of blocks at a time; only its best k per query leave it.

Ties go to the lowest position. Scores that differ by less than 1e-9 are ties, because the last
bits of a dot product depend on the order of its sums.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitgauge.operators.sampling import RunMarks, seeded_positions

# A side is broadcast up to this many bytes of float32 vectors.
BROADCAST_BYTES = 32 << 20
# Texts of winners travel with the matches up to this many winners per task.
CARRY_ROWS = 2_000
# Matches are marked for broadcast up to this many rows of about 50 bytes.
BROADCAST_ROWS = 200_000
# Queries that are compared at a time, at most; vectors of a block, and of the part of the cache that a task holds.
TILE_BYTES = 64 << 20
BLOCK_BYTES = 8 << 20
HELD_BYTES = 64 << 20
# How many tiles (pairs of parts) there should be, and how many pairs a tile may compare.
TILES_PER_CORE = 3
TILE_PAIRS = 1 << 37
MIN_TILE_ROWS = 1024
MAX_TILE_PARTITIONS = 50_000
# Partial matches of more scan tasks than this are merged in two steps.
MERGE_TASKS = 64
# One block of the similarity matrix inside a task, its queries, and the cached vectors that are brought to unit length for it.
SIMILARITY_BYTES = 16 << 20
MAX_HEIGHT = 1024
UNIT_BYTES = 8 << 20
# Lists of matches that a task has before it merges them, or cells per wanted match.
MERGE_LISTS = 16
MERGE_CELLS = 4
CELL_BYTES = 32
# Vectors of a block that are matched with each other beforehand.
FLOOR_ROWS = 4096
# Lengths between which a vector is brought to unit length in single precision.
PLAIN = (1e-30, 1e30)
TIE_DIGITS = 9
TIE_MARGIN = 1.1 * 10.0**-TIE_DIGITS
# Candidate cells per wanted match from which a block is scored in double throughout.
CROWDED = 8
# Multiplications per row from which an even spread over all cores is worth a shuffle of the rows.
SPREAD_FROM = 1 << 20
SPREAD_BYTES = 1 << 30


_NONE = np.zeros(0, dtype=np.int64)


@dataclass(frozen=True)
class MatchSpec:
    """What a match computes, apart from its input tables."""

    k: int = 1
    by: tuple[str, ...] = ()
    exclude_self: bool = False
    self_offset: int = 0
    marks: RunMarks | None = None
    height: int = MAX_HEIGHT


@dataclass
class Vectors:
    """A bounded set of vectors inside a task."""

    ids: np.ndarray
    order: np.ndarray
    group: np.ndarray
    values: np.ndarray
    is_sorted: bool = False
    floor: np.ndarray | None = None

    @staticmethod
    def from_arrow(table: pa.Table | pa.RecordBatch) -> Vectors:
        # Rows without a vector are dropped here: a filter in the plan would run an encoder twice.
        # So are vectors with an element that is missing or not finite; they match nothing.
        table = table.select(["id", "ord", "grp", "vec"])
        if table.column("vec").null_count:
            table = table.filter(pc.is_valid(table.column("vec")))
        column = table.column("vec")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False)
        n = len(column)
        dim = len(flat) // n if n else 0
        if not np.all(np.diff(column.offsets.to_numpy()) == dim):
            raise ValueError("all vectors must have the same number of dimensions")
        values = flat.reshape(n, dim).astype(np.float32, copy=False)
        made = Vectors(
            ids=table.column("id").to_numpy(), order=table.column("ord").to_numpy(),
            group=table.column("grp").to_numpy(), values=values,
        )
        usable = np.isfinite(values).all(axis=1)
        return made if usable.all() else made.take(usable)

    def take(self, rows: np.ndarray | slice, is_sorted: bool = False) -> Vectors:
        return Vectors(self.ids[rows], self.order[rows], self.group[rows], self.values[rows], is_sorted)

    @functools.cached_property
    def norms(self) -> np.ndarray:
        """Lengths of the vectors, in double."""
        squares = np.zeros(len(self.values))
        step = self.step
        for at in range(0, len(squares), step):
            wide = self.values[at : at + step].astype(np.float64)
            squares[at : at + step] = np.einsum("ij,ij->i", wide, wide)
        return np.sqrt(squares)

    @property
    def step(self) -> int:
        """How many vectors are brought to unit length at a time."""
        return max(1, UNIT_BYTES // 8 // max(1, self.values.shape[1]))

    def unit(self, rows: np.ndarray | slice) -> np.ndarray:
        """Some of the vectors in double at unit length; a vector without length stays zero."""
        wide, norms = self.values[rows].astype(np.float64), self.norms[rows]
        return np.divide(wide, norms[:, None], out=wide, where=norms[:, None] > 0)

    def rough(self, rows: np.ndarray | slice) -> np.ndarray:
        """The same in single precision, for screening; an element is off by two roundings at most."""
        norms = self.norms[rows]
        real = norms > 0
        if np.all((norms > PLAIN[0]) & (norms < PLAIN[1]) | ~real):
            return self.values[rows] * np.divide(1, norms, out=np.zeros_like(norms), where=real).astype(np.float32)[:, None]
        return self.unit(rows).astype(np.float32)

    @functools.cached_property
    def all_rough(self) -> np.ndarray:
        """All of them, kept; for the queries of a block."""
        return self.rough(slice(None))

    def packed(self) -> bytes:
        """All but the ids, for :meth:`from_packed`."""
        floor = np.full(len(self.ids), -np.inf) if self.floor is None else self.floor
        columns = self.order, self.group, self.norms, floor, self.values
        return b"".join(np.ascontiguousarray(x).tobytes() for x in columns)

    @staticmethod
    def from_packed(ids: pa.Array, data: pa.Buffer) -> Vectors:
        """Sorted vectors that were packed; they are views of ``data``."""
        n = len(ids)
        order, group = (np.frombuffer(data, dtype=np.int64, count=n, offset=8 * n * at) for at in (0, 1))
        norms, floor = (np.frombuffer(data, dtype=np.float64, count=n, offset=8 * n * at) for at in (2, 3))
        values = np.frombuffer(data, dtype=np.float32, offset=32 * n)
        made = Vectors(ids.to_numpy(), order, group, values.reshape(n, len(values) // n if n else 0), True, floor)
        made.norms = norms
        return made

    def copy(self) -> Vectors:
        columns = (x.copy() for x in (self.ids, self.order, self.group, self.values))
        made = Vectors(*columns, self.is_sorted, self.floor)
        made.norms = self.norms.copy()
        return made

    def without_values(self) -> Vectors:
        return Vectors(self.ids.copy(), self.order.copy(), self.group.copy(), self.values[:, :0].copy(), self.is_sorted)

    def sorted(self) -> Vectors:
        """The same vectors by group and position, so that each group is one slice."""
        if self.is_sorted:
            return self
        return self.take(np.lexsort((self.ids, self.order, self.group)), True)


def _first_best(scores: np.ndarray) -> np.ndarray:
    """Left-most column of each row whose rounded score is the highest.

    Only scores a hair below the maximum can round to the same number, so the first of those is
    the answer unless it happens to round differently; such rows are rounded as a whole.
    """
    top = scores.max(axis=1)
    first = np.argmax(scores >= (top - TIE_MARGIN)[:, None], axis=1)
    at_first = scores[np.arange(len(scores)), first]
    unsure = np.round(at_first, TIE_DIGITS) != np.round(top, TIE_DIGITS)
    if unsure.any():
        first[unsure] = np.argmax(np.round(scores[unsure], TIE_DIGITS), axis=1)
    return first


def _rank(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best cells of each row, equal rounded scores by column."""
    by_rank = np.lexsort((cols, -np.round(scores, TIE_DIGITS), rows))
    ranked = rows[by_rank]
    return by_rank[np.arange(len(ranked)) - np.searchsorted(ranked, ranked) < k]


def _cells_at_least_kth(
    scores: np.ndarray, k: int, slack: float, floor: np.ndarray | float = -np.inf
) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each row that are at most ``slack`` below its k-th best score, and below its ``floor``."""
    n = scores.shape[1]
    kth = scores.max(axis=1) if k == 1 else np.partition(scores, max(0, n - k), axis=1)[:, max(0, n - k)]
    least = (np.maximum(kth, floor) - slack).astype(scores.dtype)
    cells = np.flatnonzero(scores >= least[:, None])  # much faster than a 2-D nonzero
    return cells // n, cells % n


def _best_in_block(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best columns of each row; equal scores go to the left column."""
    if k == 1:
        rows, cols = np.arange(len(scores)), _first_best(scores)
    else:
        rows, cols = _cells_at_least_kth(scores, k, TIE_MARGIN)
        kept = _rank(rows, cols, scores[rows, cols], k)
        rows, cols = rows[kept], cols[kept]
    found = np.isfinite(scores[rows, cols])
    return rows[found], cols[found]


class Best:
    """The k best cells so far of each of ``n`` rows: lists that are merged from time to time.

    ``floor`` is a score that k cells of a row are known to reach, so that a cell below it (and no tie) is not looked at.
    """

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.n, self.k = n, k
        self.floor = np.full(n, -np.inf) if floor is None else floor.copy()
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.pending = 0

    def add(self, rows: np.ndarray, order: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Up to k cells of each row, by row and rank."""
        if not len(rows):
            return
        kth = np.flatnonzero(np.arange(len(rows)) - np.searchsorted(rows, rows) == self.k - 1)
        self.floor[rows[kth]] = np.maximum(self.floor[rows[kth]], scores[kth])
        self.parts.append((rows, order, ids, scores))
        self.pending += len(rows)
        if self.pending > MERGE_CELLS * self.k * self.n:
            self.kept()

    def kept(self) -> dict[str, np.ndarray]:
        best = _keep_best(self.parts, self.k)
        self.parts, self.pending = [tuple(best.values())], 0
        return best


def _winners(
    rough: np.ndarray, q: Vectors, c: Vectors, rows_at: np.ndarray, cols_at: slice, k: int, floor: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``c``, score) of the k best cells per row of a block that can still be among its k best.

    ``rough`` is the block in single precision. Its error on unit vectors is below
    ``dim * 2**-24``, so every cell that can be among the k best lies within twice that of the k-th;
    only those are scored in double. Where a row has many such cells (copies of one vector) its
    whole row is taken in double instead.
    """
    slack = 2 * (q.values.shape[1] + 16) * 2.0**-24 + TIE_MARGIN
    top = rough.max(axis=1)
    hit = np.flatnonzero((top >= floor[rows_at] - slack) & (top > -np.inf))
    if not len(hit):
        return _NONE, _NONE, np.zeros(0)
    # Taken along the axis that lies apart in memory, a line of the other one at a time.
    if len(hit) < len(rough):
        rough, rows_at = rough[hit] if rough.flags.c_contiguous else rough.T.take(hit, axis=1).T, rows_at[hit]
    rows, cols = _cells_at_least_kth(rough, k, slack, floor[rows_at])
    if len(rows) > CROWDED * k * len(hit):
        scores = q.unit(rows_at) @ c.unit(cols_at).T
        scores[np.isneginf(rough)] = -np.inf
        rows, cols = _best_in_block(scores, k)
        return rows_at[rows], cols + cols_at.start, scores[rows, cols]
    finite = np.isfinite(rough[rows, cols])
    rows, cols = rows[finite], cols[finite]
    scores = _cell_scores(q, c, rows_at[rows], cols + cols_at.start)
    kept = _rank(rows, cols, scores, k)
    return rows_at[rows[kept]], cols[kept] + cols_at.start, scores[kept]


def _cell_scores(q: Vectors, c: Vectors, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Scores in double of the cells (row of ``q``, row of ``c``)."""
    scores = np.zeros(len(rows))
    for at in range(0, len(rows), q.step):
        part = slice(at, at + q.step)
        scores[part] = np.einsum("ij,ij->i", q.unit(rows[part]), c.unit(cols[part]))
    return scores


def _block_size(q: Vectors, c: Vectors, spec: MatchSpec) -> tuple[int, int]:
    """(queries, cached vectors) of a block of the similarity matrix."""
    height = max(1, min(len(q.ids), spec.height))
    return height, max(1, min(SIMILARITY_BYTES // 8 // height, c.step))


def _match_block(q: Vectors, c: Vectors, spec: MatchSpec, found: Best, back: Best | None = None) -> None:
    """Add the best of ``c`` per vector of ``q`` within each group, block by block; both are sorted.

    ``back`` gets the best of ``q`` per vector of ``c`` from the same products.
    """
    height, width = _block_size(q, c, spec)
    room = np.empty(height * width, dtype=np.float32)
    for group in np.intersect1d(q.group, c.group):
        first, last = np.searchsorted(q.group, [group, group + 1])
        start, end = np.searchsorted(c.group, [group, group + 1])
        for left in range(start, end, width):
            block = slice(left, min(left + width, end))
            right = c.rough(block)
            for top in range(first, last, height):
                idx = slice(top, min(top + height, last))
                here = q.all_rough[idx] if q.values.nbytes <= UNIT_BYTES else q.rough(idx)
                rough = np.matmul(here, right.T, out=room[: len(here) * len(right)].reshape(len(here), len(right)))
                if spec.exclude_self:
                    rough[np.intersect1d(q.ids[idx] + spec.self_offset, c.ids[block], return_indices=True)[1:]] = -np.inf
                for a, b, to, at, cells in ((q, c, found, idx, block), (c, q, back, block, idx)):
                    if to is not None:
                        table = rough if a is q else rough.T
                        rows, cols, scores = _winners(table, a, b, np.arange(at.start, at.stop), cells, spec.k, to.floor)
                        to.add(rows, b.order[cols], b.ids[cols], scores)


def _add_best(q: Vectors, c: Vectors, spec: MatchSpec, found: Best, back: Best | None = None) -> None:
    """The same for sorted queries and any cache, or for marked rows."""
    if spec.marks is None:
        return _match_block(q, c.sorted(), spec, found, back)
    found.parts.append(tuple(_best_in_runs(q, c, spec).values()))
    found.kept()


def _best(q: Vectors, c: Vectors, spec: MatchSpec) -> dict[str, np.ndarray]:
    """Best k of ``c`` per vector of ``q``; places are those in ``q.sorted()``."""
    found = Best(len(q.ids), spec.k)
    _add_best(q.sorted(), c, spec, found)
    return found.kept()


def _add_list(parts: list[tuple[np.ndarray, ...]], here: list[tuple[np.ndarray, ...]], k: int) -> list[tuple[np.ndarray, ...]]:
    """The lists so far and those of a further block, merged from time to time."""
    if here:
        parts = [*parts, tuple(np.concatenate(column) for column in zip(*here))]
    return parts if len(parts) < MERGE_LISTS else [tuple(_keep_best(parts, k).values())]


#: Bits of a place in ``best["q"]`` that hold the run, where rows are marked with runs.
RUN_BITS = 6


def _best_in_runs(q: Vectors, c: Vectors, spec: MatchSpec) -> dict[str, np.ndarray]:
    """Best k of ``c`` per vector of ``q`` and run; ``group`` holds the bitmaps of the runs.

    Each block is multiplied once for all runs. Ties go by the run's own order, whose places are computed
    for the cells that can win.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    height, width = _block_size(q, c, spec)
    slack = 2 * (q.values.shape[1] + 16) * 2.0**-24 + TIE_MARGIN
    for left in range(0, len(c.ids), width):
        block = slice(left, left + width)
        right, here = c.rough(block), []
        for top in range(0, len(q.ids), height):
            idx = slice(top, top + height)
            rough = q.rough(idx) @ right.T
            for bit, run in enumerate(spec.marks.runs):
                rows = np.flatnonzero(q.group[idx] >> bit & 1)
                cols = np.flatnonzero(c.group[block] >> bit & 1)
                if not len(rows) or not len(cols):
                    continue
                i, j = _cells_at_least_kth(rough[np.ix_(rows, cols)], spec.k, slack)
                if len(i) > CROWDED * spec.k * len(rows):
                    scores = q.unit(rows + top) @ c.unit(cols + left).T
                    i, j = _cells_at_least_kth(scores, spec.k, TIE_MARGIN)
                    scores = scores[i, j]
                else:
                    scores = _cell_scores(q, c, rows[i] + top, cols[j] + left)
                met, back = np.unique(c.ids[block][cols[j]], return_inverse=True)
                order = seeded_positions(spec.marks.order_seed + run, met)[back]
                part = (((rows[i] + top) << RUN_BITS) + bit, order, met[back], scores)
                here.append(tuple(_keep_best([part], spec.k).values()))
        parts = _add_list(parts, here, spec.k)
    return _keep_best(parts, spec.k)


def _keep_best(parts: list[tuple[np.ndarray, ...]], k: int) -> dict[str, np.ndarray]:
    """Merge candidate lists (query row, position, id, score) into the k best per query row."""
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return {"q": none, "ord": none, "match_id": none, "score": np.zeros(0)}
    q, order, ids, score = (np.concatenate(column) for column in zip(*parts))
    by_rank = np.lexsort((ids, order, -np.round(score, TIE_DIGITS), q))
    q, order, ids, score = q[by_rank], order[by_rank], ids[by_rank], score[by_rank]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return {"q": q[keep], "ord": order[keep], "match_id": ids[keep], "score": score[keep]}


_FOUND_TYPE = "grp long, query_id long, ord long, match_id long, score double"


def _found_batch(
    q: Vectors, best: dict[str, np.ndarray], spec: MatchSpec, texts: dict[int, str] | None = None
) -> pa.RecordBatch:
    if spec.marks is None:
        rows, groups = best["q"], q.group[best["q"]]
    else:
        rows, bits = best["q"] >> RUN_BITS, best["q"] & ((1 << RUN_BITS) - 1)
        groups = np.array(spec.marks.runs, dtype=np.int64)[bits]
    columns = {
        "grp": pa.array(groups, pa.int64()),
        "query_id": pa.array(q.ids[rows], pa.int64()),
        "ord": pa.array(best["ord"], pa.int64()),
        "match_id": pa.array(best["match_id"], pa.int64()),
        "score": pa.array(best["score"], pa.float64()),
    }
    if texts is not None:
        columns["carried"] = pa.array([texts[i] for i in best["match_id"].tolist()], pa.string())
    return pa.RecordBatch.from_pydict(columns)


def _vector_rows(
    df: DataFrame, id_col: str, vector: str, order: str | None, spec: MatchSpec, carry: str | None = None, bits: str = "",
) -> DataFrame:
    """Only what the kernel reads: other columns do not travel with the vectors."""
    carried = [F.col(carry).cast("string").alias("carried")] if carry else []
    if bits:
        group = F.col(bits)
    else:
        group = F.col(spec.by[0]).cast("long") if spec.by else F.lit(0).cast("long")
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(order or id_col).cast("long").alias("ord"),
        group.alias("grp"),
        F.col(vector).cast("array<float>").alias("vec"),
        *carried,
    )


def _row_bytes(rows: DataFrame) -> int:
    """Bytes of one vector; the kernel checks that all vectors have this many dimensions."""
    first = rows.select(F.size("vec")).filter(F.col("vec").isNotNull()).first()
    return 4 * max(1, first[0] if first else 1)


def _collect_small(rows: DataFrame) -> Vectors:
    return Vectors.from_arrow(rows.toArrow()).sorted()


def _spread(rows: DataFrame, size: int, work_per_row: int) -> DataFrame:
    """Even out a table of ``size`` bytes if its rows cost far more to match than to move.

    A larger table has enough input splits for all cores and stays where it is.
    """
    if work_per_row < SPREAD_FROM or size > SPREAD_BYTES:
        return rows
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "id")


def _match_small_cache(q: DataFrame, c: DataFrame, spec: MatchSpec, size: int) -> DataFrame:
    small = _collect_small(c)
    shared = q.sparkSession.sparkContext.broadcast(small)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                queries = Vectors.from_arrow(batch).sorted()
                yield _found_batch(queries, _best(queries, shared.value, spec), spec)

    return _spread(q, size, small.values.size).mapInArrow(match, _FOUND_TYPE)


def _texts_of(best: dict[str, np.ndarray], texts: dict[int, str], batch: pa.RecordBatch) -> dict[int, str]:
    """Texts of the current winners, from the previous ones and this batch."""
    ids = batch.column("id").to_numpy()
    rows = np.flatnonzero(np.isin(ids, best["match_id"]))
    here = dict(zip(ids[rows].tolist(), batch.column("carried").take(pa.array(rows)).to_pylist()))
    return {i: here[i] if i in here else texts[i] for i in np.unique(best["match_id"]).tolist()}


def _match_few_queries(q: DataFrame, c: DataFrame, spec: MatchSpec) -> DataFrame:
    small = _collect_small(q)
    shared = q.sparkSession.sparkContext.broadcast(small)
    carry = "carried" in c.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = Best(len(queries.ids), spec.k)
        texts: dict[int, str] = {}
        for batch in batches:
            if batch.num_rows:
                _add_best(queries, Vectors.from_arrow(batch), spec, best)
                if carry:
                    texts = _texts_of(best.kept(), texts, batch)
        yield _found_batch(queries, best.kept(), spec, texts if carry else None)

    found = _FOUND_TYPE + (", carried string" if carry else "")
    if small.values.size >= SPREAD_FROM and not carry:
        c = _spread(c, c.count() * small.values.shape[1] * 4, small.values.size)
    return c.mapInArrow(scan, found)


def _tile_grid(n_held: int, n_streamed: int, max_rows: int, cores: int) -> tuple[int, int]:
    """Parts of the side that tasks hold and of the side that is streamed past it; a tile is one of each.

    A held part has at most ``max_rows`` rows, and there are as few as that allows, because each gives every query a
    list of matches. There are three tiles per core, or more if a tile would compare over ``TILE_PAIRS`` pairs, up
    to ``MAX_TILE_PARTITIONS``.
    """
    tiles = min(max(TILES_PER_CORE * cores, n_held * n_streamed // TILE_PAIRS), MAX_TILE_PARTITIONS)
    n_rows = -(-n_held // max(1, max_rows)) or 1
    n_cols = max(1, min(-(-tiles // n_rows), -(-n_streamed // MIN_TILE_ROWS)))
    return n_rows, n_cols


def _pack(rows: pa.Table, spec: MatchSpec | None) -> pa.Table:
    """One row of a block's usable vectors: sorted, with their lengths and ``floor``, as bytes."""
    block, part = (rows.column(x)[0].as_py() for x in ("block", "part"))
    made = Vectors.from_arrow(rows.combine_chunks().to_batches()[0]).sorted()
    if spec is not None:
        made.floor = np.full(len(made.ids), -np.inf)
        for at in range(0, len(made.ids), FLOOR_ROWS):
            some = made.take(slice(at, at + FLOOR_ROWS), True)
            inside = Best(len(some.ids), spec.k)
            _match_block(some, some, spec, inside)
            made.floor[at : at + FLOOR_ROWS] = inside.floor
    return pa.table({
        "block": pa.array([block], pa.int64()), "part": pa.array([part], pa.int32()),
        "ids": pa.array([made.ids], pa.list_(pa.int64())), "data": pa.array([made.packed()], pa.binary()),
    })


def _blocks(rows: DataFrame, salt: str, parts: int, size: int, spec: MatchSpec | None = None) -> DataFrame:
    """(block, ``salt``, ``salt``_data): a table of ``size`` bytes in even parts, each of a few packed blocks.

    ``salt`` lists the ids of the block's rows. Blocks are packed once and dealt out as bytes, since every tile of a part
    reads them again and sends them to Python once per pair. With ``spec`` the rows are to be matched with each other; what
    they find among a few rows of their block is the floor from which on cells are looked at.
    """
    blocks = parts * max(1, -(-size // (parts * BLOCK_BYTES)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(salt), "id", "grp"), F.lit(blocks)))
    dealt = dealt.withColumn("part", (F.col("block") % parts).cast("int")).repartitionById(parts, "part")

    def pack(block: pa.Table) -> pa.Table:
        return _pack(block, spec)

    packed = dealt.groupBy("part", "block").applyInArrow(pack, "block long, part int, ids array<long>, data binary")
    packed = packed.repartitionById(parts, "part")
    return packed.select("block", F.col("ids").alias(salt), F.col("data").alias(f"{salt}_data"))


def _triangle(n: int, max_rows: int, cores: int) -> int:
    """Parts of a table that is matched with itself, where a tile is a pair of parts in either order."""
    tiles = max(TILES_PER_CORE * cores, n * n // 2 // TILE_PAIRS)
    parts = max(-(-n // max(1, max_rows)), math.isqrt(2 * tiles))
    return max(1, min(parts, -(-n // MIN_TILE_ROWS), math.isqrt(MAX_TILE_PARTITIONS)))


def _match_tiles(
    q: DataFrame, c: DataFrame, sizes: tuple[int, int], row_bytes: int, spec: MatchSpec, same: bool = False
) -> DataFrame:
    """With ``same`` both sides are one table: a pair of blocks is multiplied once for both orders."""
    n_queries, n_cache = sizes
    cores = q.sparkSession.sparkContext.defaultParallelism
    max_rows = max(1, HELD_BYTES // row_bytes)
    # A task keeps lists for a part of the cache then.
    listed = max(1, min(max_rows, HELD_BYTES // (CELL_BYTES * spec.k * (1 + MERGE_CELLS))))
    same = same and -(-n_cache // listed) <= math.isqrt(MAX_TILE_PARTITIONS)
    if same:
        parts = _triangle(n_cache, listed, cores)
        queries = _blocks(q, "q", parts, n_cache * row_bytes, spec)
        held = queries.select(*[F.col(a).alias(b) for a, b in (("block", "other"), ("q", "c"), ("q_data", "c_data"))])
        held = held.hint("shuffle_replicate_nl")
        part, other_part = F.col("block") % parts, F.col("other") % parts
        once = (part < other_part) | ((part == other_part) & (F.col("block") <= F.col("other")))
        pairs = queries.join(held, once)
    else:
        n_held, n_streamed = _tile_grid(n_cache, n_queries, max_rows, cores)
        queries = _blocks(q, "q", n_streamed, n_queries * row_bytes)
        held = _blocks(c, "c", n_held, n_cache * row_bytes).withColumnRenamed("block", "other")
        pairs = queries.crossJoin(held.hint("shuffle_replicate_nl"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # All blocks of the cache follow each other for one block of queries.
        now, asked, best = None, None, None
        backs: dict[int, tuple[Vectors, Best]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                block, other = (batch.column(x)[row].as_py() for x in ("block", "other"))
                left, right = (
                    Vectors.from_packed(batch.column(x)[row].values, batch.column(f"{x}_data")[row].as_buffer()) for x in ("q", "c")
                )
                if block != now:
                    if now is not None:
                        yield _found_batch(asked, best.kept(), spec)
                    # A copy does not keep the batch.
                    asked = left.copy()
                    now, best = block, Best(len(asked.ids), spec.k, asked.floor)
                cache = right
                if same and other != block and other not in backs:
                    backs[other] = cache.without_values(), Best(len(cache.ids), spec.k, cache.floor)
                _add_best(asked, cache, spec, best, backs[other][1] if same and other != block else None)
        if now is not None:
            yield _found_batch(asked, best.kept(), spec)
        for cache, back in backs.values():
            yield _found_batch(cache, back.kept(), spec)

    return pairs.mapInArrow(match, _FOUND_TYPE)


def merge_best(found: DataFrame, k: int) -> DataFrame:
    """The k best of partial matches per query, ties to the lowest position."""
    tie_key = F.round("score", TIE_DIGITS)
    columns = ["match_id", "score", *(["carried"] if "carried" in found.columns else [])]
    if k == 1:
        rank_first = F.struct((-tie_key).alias("a"), "ord", *columns)
        return (
            found.groupBy("grp", "query_id").agg(F.min(rank_first).alias("m"))
            .select("grp", "query_id", *[f"m.{c}" for c in columns], F.lit(1).alias("rank"))
        )
    order = Window.partitionBy("grp", "query_id").orderBy(-tie_key, "ord", "match_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("grp", "query_id", *columns, "rank")
    )


def merge_scans(found: DataFrame, k: int, tasks: int) -> DataFrame:
    """The k best of what many scan tasks found, merged in two steps.

    First the finds of every so many tasks are merged, a key of which are rows of few tasks; so a query's last
    merge gets about the square root of their number of lists instead of one from each task.
    """
    if tasks <= MERGE_TASKS:
        return merge_best(found, k)
    lists = math.isqrt(tasks - 1) + 1
    dealt = found.withColumn("_list", F.pmod(F.spark_partition_id(), F.lit(lists)))
    order = F.struct((-F.round("score", TIE_DIGITS)).alias("a"), "ord", *[c for c in found.columns if c not in ("grp", "query_id", "ord")])
    by = ["_list", "grp", "query_id"]
    if k == 1:
        first = dealt.groupBy(*by).agg(F.min(order).alias("m")).select("grp", "query_id", "m.*").drop("a")
    else:
        place = Window.partitionBy(*by).orderBy(order)
        first = dealt.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= k).drop("_n", "_list")
    return merge_best(first, k)


def _match(
    queries: DataFrame,
    cache: DataFrame,
    *,
    query_id: str,
    cache_id: str,
    vector: str = "embedding",
    order: str | None = None,
    k: int = 1,
    by: str | None = None,
    exclude_self: bool = False,
    self_offset: int = 0,
    carry: str | None = None,
    marks: RunMarks | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """The rows of :func:`match_top_k`.

    ``carry`` names a text column of the cache. If the queries are few, each task keeps the texts
    of its winners and the result has them as ``carried``, which saves a second scan of the cache;
    otherwise it is ignored and the texts are to be joined by ``match_id``.
    """
    asked, held = (marks.asked, marks.held) if marks else ("", "")
    same = queries is cache and query_id == cache_id and order in (None, cache_id) and not marks and not self_offset
    if marks:
        queries, cache = queries.filter(F.col(asked) != 0), cache.filter(F.col(held) != 0)
    spec = MatchSpec(k, (by,) if by else (), exclude_self, self_offset, marks)
    q = _vector_rows(queries, query_id, vector, None, spec, bits=asked)
    row_bytes = _row_bytes(q)
    spec = replace(spec, height=max(1, min(MAX_HEIGHT, tile_bytes // row_bytes)))
    c = _vector_rows(cache, cache_id, vector, order, spec, bits=held)

    n_queries = queries.count()
    counted = cache.select(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.max("task").alias("last")).first()
    n_cache, tasks = counted.n, (counted.last or 0) + 1
    found_rows = n_queries * k * (len(marks.runs) if marks else 1)
    # The smaller side is the one to send to all tasks, if it is small enough.
    small_cache = n_cache <= n_queries and n_cache * row_bytes <= broadcast_bytes
    few = not small_cache and n_queries * row_bytes <= broadcast_bytes
    if small_cache:
        found = _match_small_cache(q, c, spec, n_queries * row_bytes)
    elif few:
        if carry and found_rows <= CARRY_ROWS:
            c = _vector_rows(cache, cache_id, vector, order, spec, carry, held)
        found = _match_few_queries(q, c, spec)
    elif n_cache * row_bytes <= broadcast_bytes:
        found = _match_small_cache(q, c, spec, n_queries * row_bytes)
    else:
        found = _match_tiles(q, c, (n_queries, n_cache), row_bytes, spec, same)
    found = merge_scans(found, k, tasks) if few else merge_best(found, k)
    group = [F.col("grp").alias("run" if marks else by)] if by or marks else []
    found = found.select(
        *group, F.col("query_id").alias(query_id),
        *[x for x in ("match_id", "score", "carried", "rank") if x in found.columns],
    )
    # The k rows of few queries are as bounded as the queries were, unless they carry texts.
    narrow = "carried" not in found.columns
    return F.broadcast(found) if few and narrow and found_rows <= BROADCAST_ROWS else found


def match_top_k(
    queries: DataFrame,
    cache: DataFrame,
    *,
    query_id: str,
    cache_id: str,
    vector: str = "embedding",
    order: str | None = None,
    k: int = 1,
    by: str | None = None,
    exclude_self: bool = False,
    self_offset: int = 0,
    marks: RunMarks | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """``query_id, match_id, score, rank`` (and ``by``) of the k nearest cached rows per query.

    ``by`` is an integer group key, such as the run: a query is matched only inside its group.
    ``order`` is the cache position that decides ties, ``cache_id`` unless given. With
    ``exclude_self`` a query never matches the cached row whose id is its own plus
    ``self_offset``. Queries without any candidate are absent; see :func:`with_no_hit_default`.
    With ``marks`` the rows of both tables carry bitmaps of runs instead of being repeated per run; the
    result has a ``run``, and ties go by the order of the run.
    """
    return _match(
        queries, cache, query_id=query_id, cache_id=cache_id, vector=vector, order=order, k=k, by=by,
        exclude_self=exclude_self, self_offset=self_offset, marks=marks, broadcast_bytes=broadcast_bytes,
        tile_bytes=tile_bytes,
    )


def match_top_1(queries: DataFrame, cache: DataFrame, **options) -> DataFrame:
    return match_top_k(queries, cache, k=1, **options).drop("rank")


def match_with_text(
    queries: DataFrame,
    cache: DataFrame,
    text: str,
    *,
    cache_id: str,
    texts: DataFrame | None = None,
    name: str = "matches",
    **options,
) -> DataFrame:
    """The rows of :func:`match_top_k` with the matched text as ``name``, whatever the plan.

    ``texts`` holds the text of every ``cache_id`` once, where the cache repeats its rows per group.
    """
    found = _match(queries, cache, cache_id=cache_id, carry=text if texts is None else None, **options)
    if "carried" in found.columns:
        return found.withColumnRenamed("carried", name)
    return attach_match(found, cache if texts is None else texts, cache_id, {text: name})  # winners only


def match_self(
    rows: DataFrame, *, id_col: str, candidates: DataFrame | None = None, **options
) -> DataFrame:
    """Nearest other row of the same table. Another row with the same text is a legal match."""
    cache = rows if candidates is None else candidates
    return match_top_1(rows, cache, query_id=id_col, cache_id=id_col, exclude_self=True, **options)


def attach_match(matches: DataFrame, cache: DataFrame, cache_id: str, payload: dict[str, str]) -> DataFrame:
    """Add columns of the matched cache row, renamed as in ``payload`` (cache column -> new name).

    Every match is a row of the cache, so this is an inner join in which few matches are the
    broadcast side and the cache texts are not shuffled.
    """
    wanted = cache.select(
        F.col(cache_id).alias("match_id"), *[F.col(c).alias(n) for c, n in payload.items()]
    )
    return wanted.join(matches, "match_id")


def with_no_hit_default(
    queries: DataFrame, matches: DataFrame, keys: list[str], text: str = "matches", score: str = "best_scores"
) -> DataFrame:
    """All queries: without a hit the score is 0 and the matched text empty."""
    return (
        queries.join(matches, keys, "left")
        .withColumn(score, F.coalesce(score, F.lit(0.0)))
        .withColumn(text, F.coalesce(text, F.lit("")))
    )
