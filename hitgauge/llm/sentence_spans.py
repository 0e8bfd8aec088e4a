"""Removal of repeated runs of sentences.

Sentences end after ``.``, ``!`` or ``?`` before white space and at line breaks; they are compared in lower
case with single blanks. One of more than ``LONG`` words is taken apart where the words themselves say so
(the least hash of two words among ``REACH`` on either side), and its blocks count as sentences: equal parts of
different long sentences have equal blocks, wherever they begin. From every sentence on, and up to every sentence, the shortest run with at least
``min_sentences`` sentences and ``min_words`` words is hashed (128 bits): any common passage of that size
is covered by such runs, wherever it begins. A single sentence of at least ``LONG`` words is hashed, too. A hash that occurs more than once is a repeated span; its
first occurrence is the one with the smallest (id, text hash, sentence). Sentences covered by any other
occurrence are removed, with the white space that follows them.

Plan: hashes alone are counted first (combined before the shuffle); only runs whose hash repeats go on to
the join for their first occurrence, and ranges, not texts, are gathered per document. Runs are staged. A
hash with any number of occurrences is one counted row; its members are never gathered and no pairs of
them are made, and the first occurrences of the most frequent hashes are broadcast (at most ``HOT`` rows).

Cases: NULL texts stay NULL and blank ones as they are, with no sentences; rows that repeat id and text
are one document and are treated alike; equal texts with different ids keep the smallest id's (NULL is the
smallest); a text with one sentence of fewer than ``LONG`` words is never touched; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitgauge.llm.texts import batch_like, raw, slices
from hitgauge.staging import stage

#: A hash with more than 1/HOT of the repeated runs is frequent; there cannot be more than HOT of them.
HOT = 4096
#: Words of a sentence that is a passage by itself; fewest words of a block, and most without a place to cut.
LONG, REACH, MOST = 50, 25, 150
BREAK = re.compile(rb"(?<=[.!?])[ \t\r\x0b\x0c]+|[ \t\r\x0b\x0c]*\n\s*")


def cuts(words: list[bytes]) -> list[int]:
    """Numbers of the words before which a long sentence is cut; blocks have at least ``REACH`` words."""
    n = len(words)
    codes = np.array([xxhash.xxh32_intdigest(a + b" " + b) for a, b in zip(words, words[1:])], np.int64)
    least = np.lib.stride_tricks.sliding_window_view(codes, REACH).min(axis=1)
    at = np.arange(REACH, n - REACH)  # less than all before it, and than none after it
    found = at[(codes[at] < least[at - REACH]) & (codes[at] <= least[np.minimum(at, len(least) - 1)])]
    out, last = [], 0
    for to in [*found.tolist(), n]:
        if to - last > MOST:  # the same words over and over
            out += range(last + LONG, to - REACH + 1, LONG)
        out.append(to)
        last = to
    return out[:-1]


def split(text: bytes) -> list[tuple[int, int, bytes]]:
    """(start, end, normal form) of each sentence or block; ends include the white space that follows."""
    out, at = [], 0
    for m in BREAK.finditer(text):
        out.append((at, m.end(), text[at : m.start()]))
        at = m.end()
    out.append((at, len(text), text[at:]))
    parts = []
    for a, b, s in out:
        words = s.lower().split()
        if len(words) <= LONG:
            if words:
                parts.append((a, b, b" ".join(words)))
            continue
        edges = cuts(words)
        begins = [m.start() for m in re.finditer(rb"\S+", s)] if edges else []
        places = [a, *[a + begins[i] for i in edges], b]
        edges = [0, *edges, len(words)]
        parts += [
            (x, y, b" ".join(words[i:j])) for x, y, i, j in zip(places, places[1:], edges, edges[1:])
        ]
    return parts


def runs(words: np.ndarray, min_sentences: int, min_words: int) -> np.ndarray:
    """Distinct [first, last + 1) of the shortest runs from and up to every sentence, and of every long sentence.

    ``words`` has the number of words of each sentence.
    """
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    index = np.arange(n)
    ends = np.maximum(np.searchsorted(total, total[:-1] + min_words), index + min_sentences)
    starts = np.minimum(np.searchsorted(total, total[1:] - min_words, side="right") - 1, index + 1 - min_sentences)
    forward = np.stack([index, ends], 1)[ends <= n]
    backward = np.stack([starts, index + 1], 1)[starts >= 0]
    alone = np.flatnonzero(words >= max(LONG, min_words))
    both = np.concatenate([forward, backward, np.stack([alone, alone + 1], 1)])
    code = np.unique(both[:, 0] * (n + 1) + both[:, 1])
    return np.stack([code // (n + 1), code % (n + 1)], 1)


def _spans(keyed: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    """(id, content, first, stop, h1, h2): every run of every text."""
    kind = keyed.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            owner, first, stop, hashes = [], [], [], []
            for i, text in enumerate(raw(batch, "text")):
                parts = [s for _, _, s in split(text)]
                if not parts:
                    continue
                words = np.array([s.count(b" ") + 1 for s in parts])
                found = runs(words, min_sentences, min_words)
                joined = b"\n".join(parts)
                ends = np.cumsum([len(s) + 1 for s in parts]) - 1
                begins = ends - [len(s) for s in parts]
                a, b = begins[found[:, 0]].tolist(), ends[found[:, 1] - 1].tolist()
                hashes += [xxhash.xxh3_128_digest(joined[x:y]) for x, y in zip(a, b)]
                owner.append(np.full(len(found), i))
                first.append(found[:, 0])
                stop.append(found[:, 1])
            if not hashes:
                continue
            rows = pa.array(np.concatenate(owner))
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield batch_like({
                "id": batch.column("id").take(rows),
                "content": batch.column("content").take(rows),
                "first": pa.array(np.concatenate(first), pa.int32()),
                "stop": pa.array(np.concatenate(stop), pa.int32()),
                "h1": pa.array(h[:, 0]),
                "h2": pa.array(h[:, 1]),
            })

    return keyed.mapInArrow(work, f"id {kind}, content bigint, first int, stop int, h1 bigint, h2 bigint")


def repeated_ranges(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_sentences: int = 2, min_words: int = 20
) -> DataFrame:
    """(id, content, ranges): sentence ranges to remove from each document that loses some."""
    keyed = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    spans = stage(_spans(keyed, min_sentences, min_words), "sentence-runs")
    # one half of the hash decides what can repeat at all, both halves decide what does
    again = spans.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1").select("h1")
    again = stage(again, "repeated-hashes")
    kept = stage(spans.join(again, "h1", "left_semi"), "repeated-runs")
    here = F.struct("id", "content", "first")
    least = kept.groupBy("h1", "h2").agg(F.min(here).alias("least"), F.count("*").alias("n"))
    least = stage(least.filter("n > 1"), "first-runs")
    # at most HOT hashes have more than 1/HOT of the rows: those go to all tasks, the rest is shuffled
    often = F.broadcast(least.filter(F.col("n") > kept.count() / HOT).drop("n"))
    hot = kept.join(often, ["h1", "h2"])
    cold = kept.join(often.drop("least"), ["h1", "h2"], "left_anti").join(least.drop("n"), ["h1", "h2"])
    later = hot.unionByName(cold).filter(~here.eqNullSafe(F.col("least")))
    ranges = later.select("id", "content", "first", "stop").distinct()
    return ranges.groupBy("id", "content").agg(
        F.array_sort(F.collect_list(F.struct("first", "stop"))).alias("ranges")
    )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(_doc, text, n_sentences, n_removed): every row of ``docs`` as a struct, and its text without repeats."""
    found = stage(repeated_ranges(docs, key, text, **options), "repeated-ranges")
    packed = docs.select(
        F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("_doc"),
        F.col(text).alias("text"), F.col(key).alias("_id"), F.xxhash64(text).alias("_content"),
    )
    match = packed["_id"].eqNullSafe(found["id"]) & (packed["_content"] == found["content"])
    joined = packed.join(found, match, "left").select("_doc", "text", "ranges")

    def cut(text: bytes, ranges: list[dict] | None) -> tuple[bytes, int, int]:
        parts = split(text)
        if not ranges:
            return text, len(parts), 0
        gone = np.zeros(len(parts) + 1, np.int64)
        for r in ranges:
            gone[r["first"]] += 1
            gone[r["stop"]] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        return b"".join(text[a:b] for (a, b, _), g in zip(parts, gone) if not g), len(parts), int(gone.sum())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            done = [cut(t, r) for t, r in zip(raw(batch, "text"), batch.column("ranges").to_pylist())]
            there = batch.column("text").is_valid().to_pylist()
            texts = [x[0].decode("utf-8", "replace") if ok else None for x, ok in zip(done, there)]
            yield batch_like({
                "_doc": batch.column("_doc"),
                "text": pa.array(texts, pa.string()),
                "n_sentences": pa.array([x[1] for x in done], pa.int64()),
                "n_removed": pa.array([x[2] for x in done], pa.int64()),
            })

    kind = packed.schema["_doc"].dataType.simpleString()
    return joined.mapInArrow(work, f"_doc {kind}, text string, n_sentences bigint, n_removed bigint")
