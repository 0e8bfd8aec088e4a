"""Benchmark decontamination by rare seeds and local alignment.

Texts and items are sequences of lower-case words (runs of letters, digits and underscores). Seeds are the items' runs of ``seed_words`` words, or of two in items of fewer than ``SHORT_ITEM`` words. Every whole text is searched for them; the
words around its hits, as far as the longest item reaches, are the passages. A passage is held against
every item with which it shares a seed, however many documents or items have that seed. If none of the shared
seeds is rare (in at most ``rare_share`` of the passages' documents, plus ``rare_rows``), the pair is first
screened by a bound that no match can miss: an alignment of ``min_score`` has that share of the item's words, and
they lie in a window whose width the lost points allow. Smith-Waterman alignment of words (match +2, other word -1, gap -1) then scores each
pair; the score is divided by that of a whole exact copy, and pairs from ``min_score`` on are matches.

Items are taken in blocks of about ``BLOCK_WORDS`` words, so that what is sent to the tasks has a bound
whatever the number of items; each block is held against all texts. Texts are not shuffled; passages
are staged.

Cases: NULL and empty texts or items match nothing, nor do items of a single word; repeated
items each match; rows that repeat an id give a row each where they match; no items or no texts give no
matches. Columns beyond id and text are not used.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitgauge.llm.texts import batch_like, raw, slices
from hitgauge.staging import stage

WORD = re.compile(r"\w+")
BLOCK_WORDS = 2_000_000
MATCH, OTHER, GAP = 2, -1, -1
#: Items of fewer words have seeds of two words: a run of three is too much to ask of their edited copies.
SHORT_ITEM = 10
#: An odd multiplier for the codes of word runs; equal codes are only candidates.
MIX = np.uint64(0x9E3779B97F4A7C15)


_NO_SEED = np.zeros(0, np.int64)


def words(text: bytes) -> list[str]:
    return WORD.findall(text.decode("utf-8", "replace").lower())


def run_codes(numbers: np.ndarray, n: int) -> np.ndarray:
    """Code of each run of ``n`` word numbers."""
    if len(numbers) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(numbers) - n + 1, np.uint64)
    for i in range(n):
        out = (out + numbers[i : i + len(out)].astype(np.uint64) + np.uint64(1)) * MIX
        out ^= out >> np.uint64(29)
    return out


class Items:
    """A block of items as word numbers, with the sorted codes of their seeds and who has each."""

    def __init__(self, texts: list[bytes], n: int):
        self.numbers: dict[str, int] = {}
        self.n = n
        self.items = [
            np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words(t)], np.int64) for t in texts
        ]
        self.reach = max([len(x) for x in self.items], default=0)
        #: (words of a run, sorted codes, number of the first); seeds are numbered through all lengths
        self.runs: list[tuple[int, np.ndarray, int]] = []
        self.owners: list[list[int]] = []
        for size in sorted({min(n, 2), n}):
            owners = defaultdict(list)
            for i, x in enumerate(self.items):
                if size == (min(n, 2) if len(x) < SHORT_ITEM else n):
                    for c in set(run_codes(x, size).tolist()):
                        owners[c].append(i)
            if owners:
                self.runs.append((size, np.array(sorted(owners), np.uint64), len(self.owners)))
                self.owners += [owners[c] for c in sorted(owners)]
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([np.zeros(0, np.int64), *self.items])

    def possible(self, text: np.ndarray, candidates: list[int], min_score: float) -> list[int]:
        """The candidates that can reach ``min_score`` in a text of word numbers: none that does is left out."""
        there = np.zeros(len(self.numbers) + 1, bool)  # the last place stands for unknown words
        there[text] = True
        there[-1] = False
        own = np.array(candidates, np.int64)
        size = self.sizes[own]
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) + np.repeat(self.firsts[own] - first, size)
        enough = np.add.reduceat(there[self.flat[place]], first, dtype=np.int64) >= min_score * size
        out = []
        for j in own[enough].tolist():
            item = self.items[j]
            # a point is lost for every word of the text that is not the item's, so few can lie between
            width = int((MATCH + 1 - MATCH * min_score) * len(item)) + 1
            there[:] = False
            there[item] = True
            total = np.concatenate([[0], np.cumsum(there[text])])
            most = total[-1] if len(text) <= width else (total[width:] - total[:-width]).max()
            if most >= min_score * len(item):
                out.append(j)
        return out

    def hits(self, text: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(words of the text, positions of seeds, numbers of the seeds)"""
        parts = words(text)
        get = self.numbers.get
        known = np.fromiter((get(w, -1) for w in parts), np.int64, len(parts))
        unknown = np.concatenate([[0], np.cumsum(known < 0)])
        places, seeds = [_NO_SEED], [_NO_SEED]
        for n, codes, first in self.runs:
            whole = np.flatnonzero(unknown[n:] == unknown[:-n]) if len(parts) >= n else _NO_SEED
            if len(whole):
                code = run_codes(known, n)[whole]
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                ok = codes[at] == code
                places.append(whole[ok])
                seeds.append(at[ok] + first)
        place, seed = np.concatenate(places), np.concatenate(seeds)
        order = np.argsort(place, kind="stable")
        return parts, place[order], seed[order]


def passages(docs: DataFrame, items: Items) -> DataFrame:
    """(id, content, start, words, seeds): parts of texts around seeds, ``words`` joined by blanks."""
    held = docs.sparkSession.sparkContext.broadcast(items)
    kind = docs.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for batch in slices(batches, "text"):
            rows, starts, parts, seeds = [], [], [], []
            for i, text in enumerate(raw(batch, "text")):
                tokens, at, seed = block.hits(text)
                if not len(at):
                    continue
                cuts = np.flatnonzero(np.diff(at) > 2 * block.reach) + 1
                for a, s in zip(np.split(at, cuts), np.split(seed, cuts)):
                    low = max(0, int(a[0]) - block.reach)
                    rows.append(i)
                    starts.append(low)
                    parts.append(" ".join(tokens[low : int(a[-1]) + block.n + block.reach]))
                    seeds.append(np.unique(s).tolist())
            if rows:
                take = pa.array(rows, pa.int64())
                yield batch_like({
                    "id": batch.column("id").take(take),
                    "content": batch.column("content").take(take),
                    "start": pa.array(starts, pa.int64()),
                    "words": pa.array(parts, pa.string()),
                    "seeds": pa.array(seeds, pa.list_(pa.int32())),
                })

    return docs.mapInArrow(
        work, f"id {kind}, content bigint, start bigint, words string, seeds array<int>"
    )


def align(texts: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair of word numbers, and where it ends in the text.

    All pairs of a call advance together, one item word at a time; gaps in the text direction are a
    running maximum, because gap costs are linear.
    """
    p, width, height = len(texts), max(map(len, texts)), max(map(len, items))
    grid = np.full((p, width), -1, np.int64)
    for i, t in enumerate(texts):
        grid[i, : len(t)] = t
    wanted = np.full((p, height), -2, np.int64)
    for i, t in enumerate(items):
        wanted[i, : len(t)] = t
    slope = -GAP * np.arange(width + 1, dtype=np.int32)
    row = np.zeros((p, width + 1), np.int32)
    best, end = np.zeros(p, np.int32), np.zeros(p, np.int64)
    for k in range(height):
        same = grid == wanted[:, k : k + 1]
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(same, MATCH, OTHER), row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope, axis=1) - slope
        at = row.argmax(axis=1)
        top = row[np.arange(p), at]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at, end)
    return best, end


def _matches(
    found: DataFrame, items: Items, common: set[int], min_score: float, kind: str
) -> DataFrame:
    """(id, content, item, score, start, stop) of the passages that align with an item."""
    held = found.sparkSession.sparkContext.broadcast((items, common))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, often = held.value
        get = block.numbers.get
        for batch in slices(batches, "words", 1 << 20):
            jobs = []
            texts = [np.array([get(w, -1) for w in t.split()], np.int64) for t in batch.column("words").to_pylist()]
            for i, seeds in enumerate(batch.column("seeds").to_pylist()):
                rare, many = set(), set()
                for s in seeds:
                    (many if s in often else rare).update(block.owners[s])
                many = sorted(many - rare)
                if many:
                    rare.update(block.possible(texts[i], many, min_score))
                jobs += [(i, j) for j in sorted(rare)]
            jobs.sort(key=lambda x: (len(texts[x[0]]), len(block.items[x[1]])))
            rows, item, score, stop, at = [], [], [], [], 0
            while at < len(jobs):
                size = max(1, min(256, (1 << 20) // (len(texts[jobs[min(at + 255, len(jobs) - 1)][0]]) + 1)))
                part, at = jobs[at : at + size], at + size
                best, end = align([texts[i] for i, _ in part], [block.items[j] for _, j in part])
                whole = np.array([MATCH * len(block.items[j]) for _, j in part])
                for x in np.flatnonzero(best >= min_score * whole):
                    rows.append(part[x][0])
                    item.append(part[x][1])
                    score.append(float(best[x] / whole[x]))
                    stop.append(int(end[x]))
            if rows:
                take = pa.array(rows, pa.int64())
                start = batch.column("start").take(take).to_numpy()
                yield batch_like({
                    "id": batch.column("id").take(take),
                    "content": batch.column("content").take(take),
                    "item": pa.array(item, pa.int64()),
                    "score": pa.array(score, pa.float64()),
                    "stop": pa.array(start + np.array(stop)),
                })

    return found.mapInArrow(work, f"id {kind}, content bigint, item bigint, score double, stop bigint")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    seed_words: int = 3,
    min_score: float = 0.5,
    rare_share: float = 1e-4,
    rare_rows: int = 10,
) -> DataFrame:
    """(id, content, item_id, score, stop): documents and the benchmark items that they contain.

    ``content`` is the hash of the text, ``score`` the best alignment's share of a whole exact copy, ``stop``
    the number of words of the text up to the end of that alignment.
    """
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    items = benchmark.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
    items = stage(items, "benchmark-items")
    size, n_docs = items.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0, rows.count()
    blocks = max(1, -(-int(size) // BLOCK_WORDS))
    parts = []
    for number in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).toArrow()
        block = Items(raw(_one(mine), "text"), seed_words)
        found = stage(passages(rows, block), "passages")
        often = found.select(F.explode("seeds").alias("seed")).groupBy("seed").count()
        often = often.filter(F.col("count") > rare_rows + rare_share * n_docs).select("seed").toArrow()
        matched = _matches(found, block, set(often.column("seed").to_pylist()), min_score, kind)
        names = docs.sparkSession.createDataFrame(
            pa.table({"item": pa.array(range(mine.num_rows), pa.int64()), "item_id": mine.column("item_id")})
        )
        best = matched.groupBy("id", "content", "item").agg(F.max(F.struct("score", "stop")).alias("m"))
        parts.append(best.join(names, "item").select("id", "content", "item_id", "m.score", "m.stop"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _one(table: pa.Table) -> pa.RecordBatch:
    """A table as one batch."""
    whole = table.combine_chunks()
    if not whole.num_rows:
        return pa.RecordBatch.from_pylist([], schema=whole.schema)
    return whole.to_batches()[0]


def clean_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    found = contaminated(docs, benchmark, key, text, **options).select("id", "content").distinct()
    found = stage(found, "contaminated")
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(key).alias("_id"), F.xxhash64(text).alias("_content"))
    match = packed["_id"].eqNullSafe(found["id"]) & (packed["_content"] == found["content"])
    return packed.join(found, match, "left_anti").select("_doc.*")
