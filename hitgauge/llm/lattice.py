"""Likelihood of texts under a lattice of subwords.

The model is a unigram language model over the pieces of an existing vocabulary, the 256 bytes and an end
of text. A text is its words ``[^\\x20\\x09-\\x0D]+`` in lower case (A-Z only), each led by a blank, and one
end. Its probability is the sum, over all ways to write it as pieces, of the product of their
probabilities; a forward recursion in log space sums them up, word by word because no piece reaches over
a blank's left side. As every sequence of pieces spells one text, the probabilities of all texts sum to
at most 1. Bytes are pieces, so every text has a probability above 0.

Piece probabilities start as add-``SMOOTHING`` frequencies of the vocabulary's own segmentation of all words
of the training documents; ``passes`` of expectation and maximisation then replace them by expected
frequencies over all segmentations (forward and backward sums over the counted words). The word counts
behind them also give the base score.

Words of more than ``SHORT`` bytes are taken one by one, in stretches: only sums per place are held for the whole word, and
pieces are found for a stretch at a time by following their common beginnings.

Plan: training words are counted in tasks, then in one shuffle, and staged. The most frequent ones (at most
``HEAD_WORDS`` words of ``HEAD_BYTES`` bytes in all, cut by a histogram of the counts; a word of more than 64 bytes needs a count
higher by its length) go to all tasks with count and likelihood; so hot words never are join keys. A second pass over the texts sums up what the head and the lattice tell and lists only the
other words of each document, which are joined with the staged counts.

Cases: NULL and blank texts have the end as their only token; a word of any length is learned from and scored; without
training documents all counts are 0 and pieces have equal probabilities; rows that repeat an id are scored
one by one; a NULL id is kept; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitgauge.llm.texts import batch_like, numbered, raw, slices
from hitgauge.staging import stage

SMOOTHING = 0.5
HEAD_WORDS, HEAD_BYTES = 1 << 18, 1 << 25
#: Distinct words a task holds before it hands their counts on.
HELD_WORDS = 400_000
#: Words up to this length are scored together with others of their length.
SHORT = 48
#: Places of a longer word whose pieces are found at once.
STRETCH = 1 << 16
LN10 = math.log(10)
BASE = np.uint64(0x9E3779B97F4A7C15)


def read_pieces(path: str) -> tuple[list[bytes | None], bytes]:
    """(spelling of each piece or None, the file's content); a byte piece is spelled by its byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: list[bytes | None] = []
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            pieces.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            pieces.append(None)
        else:
            pieces.append(model.id_to_piece(i).replace("▁", " ").encode())
    return pieces, open(path, "rb").read()


@dataclass
class Lattice:
    """Natural logarithms of the probabilities of pieces, and the recursion over them."""

    scores: dict[bytes, float]
    end: float
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    pieces: dict[int, list[bytes]] = field(default_factory=dict)
    beginnings: dict[int, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.scores))
        for size in sorted(set(map(len, self.scores))):
            own = [(p, s) for p, s in self.scores.items() if len(p) == size]
            codes = _prefixes(np.frombuffer(b"".join(p for p, _ in own), np.uint8).reshape(-1, size))[:, -1]
            order = np.argsort(codes)
            self.tables[size] = codes[order], np.array([s for _, s in own])[order]
            self.pieces[size] = [own[i][0] for i in order]
        for size in range(1, self.longest + 1):
            begun = {p[:size] for p in self.scores if len(p) >= size}
            self.beginnings[size] = np.sort(_prefixes(np.frombuffer(b"".join(begun), np.uint8).reshape(-1, size))[:, -1])

    def _found(self, data: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stop, size, place in the size's table) of the pieces of a word that stop after ``low`` and up to ``high``, by stop."""
        start = np.arange(max(0, low + 1 - self.longest), high)
        code = np.zeros(len(start), np.uint64)
        found = [(np.empty(0, np.int64),) * 3]
        for size in range(1, self.longest + 1):
            inside = start + size <= high
            start, code = start[inside], code[inside]
            code = code * BASE + data[start + size - 1].astype(np.uint64) + np.uint64(1)
            begun = _places(self.beginnings[size], code) >= 0
            start, code = start[begun], code[begun]
            if not len(start):
                break
            if size in self.tables:
                at = _places(self.tables[size][0], code)
                hit = np.flatnonzero((at >= 0) & (start + size > low))
                found.append((start[hit] + size, np.full(len(hit), size), at[hit]))
        stops, sizes, at = map(np.concatenate, zip(*found))
        order = np.argsort(stops, kind="stable")
        return stops[order], sizes[order], at[order]

    def _scores_of(self, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at))
        for size in np.unique(sizes):
            own = sizes == size
            out[own] = self.tables[size][1][at[own]]
        return out

    def _long_forward(self, data: np.ndarray) -> np.ndarray:
        """Log sums over all ways to write a word up to each place."""
        alpha = array("d", bytes(8 * (len(data) + 1)))
        exp, log = math.exp, math.log
        for low in range(0, len(data), STRETCH):
            high = min(low + STRETCH, len(data))
            stops, sizes, at = self._found(data, low, high)
            starts, scores = (stops - sizes).tolist(), self._scores_of(sizes, at).tolist()
            cuts = np.searchsorted(stops, np.arange(low + 1, high + 2)).tolist()
            for place in range(low + 1, high + 1):
                ways = [alpha[starts[i]] + scores[i] for i in range(cuts[place - low - 1], cuts[place - low])]
                top = max(ways)
                alpha[place] = top + log(sum([exp(x - top) for x in ways]))
        return np.frombuffer(alpha)

    def long_word(self, word: bytes) -> float:
        """Log probability of one word, a stretch at a time."""
        return float(self._long_forward(np.frombuffer(word, np.uint8))[-1])

    def long_expected(self, word: bytes, times: float, total: dict[int, np.ndarray]) -> None:
        """Add to ``total`` (by size) how often each piece is expected in one word, a stretch at a time.

        Stretches go from the last to the first: the chance to pass a place is dealt to the pieces that stop there by
        their shares of the forward sum, and on to the places where they start.
        """
        data = np.frombuffer(word, np.uint8)
        alpha = self._long_forward(data)
        first = (len(data) - 1) // STRETCH * STRETCH
        passed = [0.0] * (len(data) - first + self.longest) + [1.0]  # of the places from low - longest to high
        for low in range(first, -1, -STRETCH):
            high = min(low + STRETCH, len(data))
            stops, sizes, at = self._found(data, low, high)
            share = np.exp(alpha[stops - sizes] + self._scores_of(sizes, at) - alpha[stops])
            places = stops - low + self.longest
            for stop, size, part in zip(places[::-1].tolist(), sizes[::-1].tolist(), share[::-1].tolist()):
                passed[stop - size] += passed[stop] * part
            chance = np.array(passed)[places] * share * times
            for size in np.unique(sizes):
                own = sizes == size
                total[size] += np.bincount(at[own], weights=chance[own], minlength=len(total[size]))
            passed = [0.0] * STRETCH + passed[: self.longest + 1]

    def _forward(self, data: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """(sums up to each place, [stop, size, rows, places in the size's table] of all pieces found)"""
        n, length = data.shape
        codes, power = _prefixes(data), np.cumprod(np.r_[np.uint64(1), np.full(length, BASE)])
        alpha, found = np.full((length + 1, n), -np.inf), []
        alpha[0] = 0
        for stop in range(1, length + 1):
            for size, (keys, scores) in self.tables.items():
                if size > stop:
                    break
                code = codes[:, stop] - codes[:, stop - size] * power[size]
                at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == code)
                at = at[hit]
                alpha[stop, hit] = np.logaddexp(alpha[stop, hit], alpha[stop - size, hit] + scores[at])
                found.append((stop, size, hit, at))
        return alpha, found

    def equal_words(self, data: np.ndarray) -> np.ndarray:
        """Log probabilities of words of one length, a row of bytes each."""
        return self._forward(data)[0][-1]

    def equal_expected(self, data: np.ndarray, times: np.ndarray, total: dict[int, np.ndarray]) -> None:
        """Add to ``total`` (by size) how often each piece is expected in the words, ``times`` each."""
        alpha, found = self._forward(data)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        for stop, size, hit, at in reversed(found):
            scores = self.tables[size][1][at]
            after = beta[stop, hit] + scores
            chance = np.exp(alpha[stop - size, hit] + after - alpha[-1, hit])
            total[size] += np.bincount(at, weights=chance * times[hit], minlength=len(total[size]))
            beta[stop - size, hit] = np.logaddexp(beta[stop - size, hit], after)

    def expected(self, words: list[bytes], times: np.ndarray) -> dict[int, np.ndarray]:
        """By size, the expected number of each piece (in the order of the size's table) in counted words."""
        total = {size: np.zeros(len(keys)) for size, (keys, _) in self.tables.items()}
        for own, data in _by_length(words):
            if data.shape[1] <= SHORT:
                self.equal_expected(data, times[own], total)
            else:
                for word, n in zip(data, times[own]):
                    self.long_expected(word.tobytes(), n, total)
        return total

    def words(self, words: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word, its leading blank included."""
        out = np.empty(len(words))
        for own, data in _by_length(words):
            out[own] = self.equal_words(data) if data.shape[1] <= SHORT else [self.long_word(x.tobytes()) for x in data]
        return out / LN10


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes with the leading blank) of the words, in matrices of one length of at most 2**18 bytes or a row."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        step = max(1, (1 << 18) // (int(size) + 1))
        for part in (own[i : i + step] for i in range(0, len(own), step)):
            yield part, np.frombuffer(b"".join(b" " + words[i] for i in part), np.uint8).reshape(len(part), -1)


def _prefixes(data: np.ndarray) -> np.ndarray:
    """Polynomial codes of the prefixes of each row, from the empty one on."""
    out = np.zeros((data.shape[0], data.shape[1] + 1), np.uint64)
    for i in range(data.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + data[:, i].astype(np.uint64) + np.uint64(1)
    return out


def _places(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Place of each code among the sorted keys, -1 where it is not there."""
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return np.where(keys[at] == codes, at, -1)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n): words of all texts in lower case, counted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return batch_like({"word": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})

        for batch in slices(batches, "text"):
            for text in raw(batch, "text"):
                held.update(text.lower().split())
            if len(held) > HELD_WORDS:
                yield out()
                held.clear()
        if held:
            yield out()

    counted = texts.select("text").mapInArrow(work, "word binary, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def train(words: DataFrame, n_docs: int, path: str, passes: int = 2) -> Lattice:
    """Piece probabilities from counted words; one row per piece comes to the driver."""
    pieces, file = read_pieces(path)
    held = words.sparkSession.sparkContext.broadcast(file)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_proto=held.value)
        total = np.zeros(model.get_piece_size(), np.int64)
        for batch in slices(batches, "word", 1 << 20):
            found = model.encode([w.decode("utf-8", "replace") for w in raw(batch, "word")], num_threads=1)
            n = np.repeat(batch.column("n").to_numpy(), [len(x) for x in found])
            np.add.at(total, np.concatenate([np.array(x, np.int64) for x in found]), n)
        seen = np.flatnonzero(total)
        yield batch_like({"piece": pa.array(seen), "n": pa.array(total[seen])})

    counted = words.mapInArrow(work, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(len(pieces))
    count[counted.column("piece").to_numpy()] = counted.column("n").to_numpy()
    usable = [i for i, p in enumerate(pieces) if p and b" " not in p[1:]]
    whole = count[usable].sum() + n_docs + SMOOTHING * (len(usable) + 1)
    scores: dict[bytes, float] = {}
    for i in usable:  # a byte and a piece may be spelled alike; both ways count
        p = (count[i] + SMOOTHING) / whole
        scores[pieces[i]] = math.log(math.exp(scores.get(pieces[i], -math.inf)) + p)
    lattice = Lattice(scores, math.log((n_docs + SMOOTHING) / whole))
    for _ in range(passes):
        lattice = _improved(words, n_docs, lattice)
    return lattice


def _improved(words: DataFrame, n_docs: int, lattice: Lattice) -> Lattice:
    """The lattice with the expected frequencies of its pieces; a row per piece comes to the driver."""
    held = words.sparkSession.sparkContext.broadcast(lattice)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in slices(batches, "word", 1 << 20):
            for size, n in held.value.expected(raw(batch, "word"), batch.column("n").to_numpy()).items():
                total[size] = total.get(size, 0) + n
        for size, n in total.items():
            seen = np.flatnonzero(n)
            yield batch_like({
                "size": pa.array(np.full(len(seen), size, np.int64)), "at": pa.array(seen), "n": pa.array(n[seen])
            })

    found = words.mapInArrow(work, "size bigint, at bigint, n double").groupBy("size", "at").agg(F.sum("n").alias("n"))
    found = found.toArrow()
    count = {piece: 0.0 for piece in lattice.scores}
    for size, at, n in zip(*(found.column(c).to_pylist() for c in ("size", "at", "n"))):
        count[lattice.pieces[size][at]] = n
    whole = sum(count.values()) + n_docs + SMOOTHING * (len(count) + 1)
    scores = {piece: math.log((n + SMOOTHING) / whole) for piece, n in count.items()}
    return Lattice(scores, math.log((n_docs + SMOOTHING) / whole))


def _frequent(counts: DataFrame) -> DataFrame:
    """The most frequent words, at most ``HEAD_WORDS`` of ``HEAD_BYTES`` bytes, by steps of an eighth of a doubling."""
    size = F.octet_length("word")
    step = F.floor(F.log2(F.col("n") * 64 / F.greatest(size, F.lit(64))) * 8)
    words, octets, cut = 0, 0, None
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum(size).alias("octets"))
    for row in steps.orderBy(F.desc("step")).collect():
        words, octets = words + row["words"], octets + row["octets"]
        if words > HEAD_WORDS or octets > HEAD_BYTES:
            break
        cut = row["step"]
    return counts.filter(step >= cut) if cut is not None else counts.limit(0)


def score(
    docs: DataFrame, trained: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """(key, *keep, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``trained`` are the documents to learn from, ``path`` is a vocabulary file of sentencepiece.
    """
    spark = docs.sparkSession
    learned = trained.select(F.col(text).alias("text"))
    n_docs = learned.count()
    counts = stage(word_counts(learned), "word-counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = tokens + n_docs, distinct + (n_docs > 0)
    lattice = train(counts, n_docs, path)
    model = spark.sparkContext.broadcast(lattice)
    below = tokens + distinct + 1

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word", 1 << 20):
            rated = model.value.words(raw(batch, "word"))
            yield batch_like({"word": batch.column("word"), "n": batch.column("n"), "p": pa.array(rated)})

    head = _frequent(counts).mapInArrow(rate, "word binary, n bigint, p double").toArrow()
    common = spark.sparkContext.broadcast((
        {w: i for i, w in enumerate(head.column("word").to_pylist())},
        np.log10((head.column("n").to_numpy() + 1) / below),
        head.column("p").to_numpy(),
    ))
    end_base, end_score = math.log10((n_docs + 1) / below), lattice.end / LN10

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, base_of, score_of = common.value
        base_of, score_of = np.r_[base_of, 0.0], np.r_[score_of, 0.0]
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            words, ids, sizes = numbered(raw(batch, "text"), lower=True)
            n = batch.num_rows
            owner = np.repeat(np.arange(n), sizes)
            place = np.array([places.get(w, -1) for w in words], np.int64)
            base, p = base_of[place], score_of[place]
            rare = np.flatnonzero(place < 0)
            if len(rare):
                base[rare], p[rare] = 0.0, model.value.words([words[i] for i in rare])
            known = place >= 0
            pair, times = np.unique(owner[~known[ids]] * (len(words) + 1) + ids[~known[ids]], return_counts=True)
            of, which = pair // (len(words) + 1), pair % (len(words) + 1)
            cuts = pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=n))], pa.int32())

            def sums(values: np.ndarray) -> np.ndarray:
                return np.bincount(owner, weights=values[ids], minlength=n) if len(ids) else np.zeros(n)

            yield batch_like({
                "row": pa.array(row + np.arange(n)),
                "_doc": batch.column("_doc"),
                "n_tokens": pa.array(sizes + 1),
                "n_known": pa.array(sums(known.astype(float)).astype(np.int64) + (n_docs > 0)),
                "base_score": pa.array(sums(base) + end_base),
                "score": pa.array(sums(p) + end_score),
                "words": pa.ListArray.from_arrays(cuts, pa.array([words[i] for i in which], pa.binary())),
                "times": pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int64))),
            })
            row += n

    packed = docs.select(F.struct(key, *(keep or [])).alias("_doc"), F.col(text).alias("text"))
    kind = packed.schema["_doc"].dataType.simpleString()
    measured = "n_tokens bigint, n_known bigint, base_score double, score double"
    passed = packed.mapInArrow(
        work, f"row bigint, _doc {kind}, {measured}, words array<binary>, times array<bigint>"
    )
    passed = stage(passed, "document-scores")
    rest = passed.select("row", F.explode(F.arrays_zip("words", "times")).alias("w"))
    rest = rest.select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rest = rest.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(below)))).alias("more_base"),
    )
    return passed.drop("words", "times").join(rest, "row", "left").select(
        "_doc.*",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
