"""Quality rules on repeated substrings, found by a suffix array.

Texts are sequences of words ``[^\\x20\\x09-\\x0D]+``. A task builds one suffix array over a slice of its
texts by prefix doubling (equal words of different texts count as different, so nothing is shared
between texts), keeps the ranks of every doubling step, and reads the longest common prefixes of
neighbouring suffixes from them. A position's longest repeat is the larger of its suffix's two common
prefixes: the widest longest-common-prefix interval that holds it. The spans of these maximal repeated
substrings are united; a document fails if they cover too large a share of its words or if one is too
long. Both limits reach further than the base rules: the share is below theirs, and the longest repeat is
bounded in words, whatever the length of the text. Each text is sent to Python once, within its row.

Cases: a NULL text, an empty one and one of white space have no words and fail the base rules; a text
of any length is one unit of work with memory in proportion to its words; repeated rows are judged
alike; an empty table gives an empty table. There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitgauge.llm.texts import batch_like, numbered, raw, slices, with_struct

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Base rules: fewest words, words of a window, most percent of words in repeated windows.
BASE_WORDS, WINDOW, BASE_PERCENT = 10, 5, 20

#: Bytes of text under one suffix array, which takes many times as many; a longer text has its own.
ARRAY_BYTES = 1 << 20

MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, covered_words bigint, longest_repeat bigint, "
    "spans array<struct<start:bigint,end:bigint>>, kept boolean"
)


def suffix_repeats(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring that starts there and occurs again.

    ``symbols`` are integers, ``owner`` is the non-decreasing number of the text of each position.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    pair = owner.astype(np.int64) * (int(symbols.max()) + 1) + symbols
    suffixes = np.argsort(pair, kind="stable")
    fresh = np.r_[True, np.diff(pair[suffixes]) != 0]
    rank = np.empty(n, np.int64)
    rank[suffixes] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    ends = np.searchsorted(owner, owner, side="right")
    levels, width = [rank.astype(np.int32)], 1
    place = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))  # places in the array still to be sorted
    while len(place):
        at = suffixes[place]
        group = rank[at]
        then = np.where(at + width < ends[at], rank[np.minimum(at + width, n - 1)] + 1, 0)
        by = np.argsort(group * (n + 1) + then, kind="stable")
        at, group, then = at[by], group[by], then[by]
        new_group = np.r_[True, np.diff(group) != 0]
        fresh = new_group | np.r_[True, np.diff(then) != 0]
        index = np.arange(len(at))
        first = np.maximum.accumulate(np.where(new_group, index, 0))
        start = np.maximum.accumulate(np.where(fresh, index, 0))
        suffixes[group + index - first] = at
        rank[at] = group + start - first
        levels.append(rank.astype(np.int32))
        width *= 2
        place = (group + index - first)[~(fresh & np.r_[fresh[1:], True])]
    common = np.zeros(n + 1, np.int64)  # common[r]: of the suffixes in places r - 1 and r
    pairs = 1 + np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]])
    a, b, length = suffixes[pairs - 1], suffixes[pairs], np.zeros(len(pairs), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        same = (x < n) & (y < n)
        same[same] = levels[level][x[same]] == levels[level][y[same]]
        length[same] += 1 << level
    common[pairs] = length
    longest = np.empty(n, np.int64)
    longest[suffixes] = np.maximum(common[:-1], common[1:])
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions in the union of [start, start + length)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def _lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes], min_words: int, most_share: float, most_words: int) -> dict[str, pa.Array]:
    """One array per measure for the given UTF-8 texts."""
    _, ids, counts = numbered(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    longest = suffix_repeats(ids, owner)
    n = len(owner)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=len(texts)).astype(np.int64)

    base = np.flatnonzero(longest >= WINDOW)
    repeated = per_text(covered(base, np.full(len(base), WINDOW), n))
    long = np.flatnonzero(longest >= min_words)
    mask = covered(long, longest[long], n)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, owner, longest)
    share = per_text(mask)

    first = np.cumsum(counts) - counts
    edge = mask & (np.r_[True, ~mask[:-1]] | np.r_[True, np.diff(owner) != 0]) if n else mask
    stop = mask & (np.r_[~mask[1:], True] | np.r_[np.diff(owner) != 0, True]) if n else mask
    starts, stops = np.flatnonzero(edge), np.flatnonzero(stop) + 1
    n_spans = np.bincount(owner[starts], minlength=len(texts))
    spans = pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.cumsum(n_spans)], pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(starts - first[owner[starts]]), pa.array(stops - first[owner[starts]])], names=["start", "end"]
        ),
    )
    decoded = [t.decode("utf-8", "replace") for t in texts]
    failed = (counts < BASE_WORDS) | (100 * repeated > BASE_PERCENT * counts)
    bad = (share > most_share * counts) | (most > most_words)
    whole = lambda f: pa.array([f(t) for t in decoded], pa.int64())
    return {
        "n_words": pa.array(counts),
        "word_chars": whole(lambda t: len(t) - sum(map(t.count, SPACES))),
        "n_symbols": whole(lambda t: sum(map(t.count, SYMBOLS))),
        "n_dup_lines": whole(_lines),
        "n_repeat_words": pa.array(repeated),
        "base_failed": pa.array(failed),
        "covered_words": pa.array(share),
        "longest_repeat": pa.array(most),
        "spans": spans,
        "kept": pa.array(~failed & ~bad),
    }


def judged(batches: Iterator[pa.RecordBatch], place: int, *limits: float) -> Iterator[pa.RecordBatch]:
    """(_doc, repetition) of batches with the struct ``_doc``, whose field number ``place`` is the text."""
    fields = [f.strip().split(" ")[0] for f in MEASURES.split(", ")]
    held = (batch_like({"_doc": b.column("_doc"), "_text": b.column("_doc").field(place)}) for b in batches)
    for batch in slices(held, "_text", ARRAY_BYTES):
        found = measure(raw(batch, "_text"), *limits)
        struct = pa.StructArray.from_arrays([found[f] for f in fields], names=fields)
        yield batch_like({"_doc": batch.column("_doc"), "repetition": struct})


def judge(
    docs: DataFrame, text: str = "text", min_words: int = 8, most_share: float = 0.1, most_words: int = 50
) -> DataFrame:
    """(_doc, repetition): every row of ``docs`` as a struct, and its measures as another.

    ``kept`` is false where the base rules fail, where repeated substrings of at least ``min_words`` words
    cover more than ``most_share`` of the words, or where one repeat has more than ``most_words`` words.
    """
    packed = with_struct(docs, "_doc")
    names = packed.schema["_doc"].dataType.names
    place = names.index(text) if text in names else [n.lower() for n in names].index(text.lower())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return judged(batches, place, min_words, most_share, most_words)

    kind = packed.schema["_doc"].dataType.simpleString()
    typed = ",".join(":".join(f.strip().split(" ", 1)) for f in MEASURES.split(", "))
    return packed.mapInArrow(work, f"_doc {kind}, repetition struct<{typed}>")


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows that pass, with all columns of ``docs`` and no others."""
    return judge(docs, **options).filter("repetition.kept").select("_doc.*")
