"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``order`` bytes with frozen counts. A byte that was
seen after a context costs log2((total + distinct) / count) bits there; one that was not costs the escape,
log2((total + distinct) / distinct), and is then coded after the context without its first byte, down to
a uniform 8 bits. A context that was never seen costs nothing and escapes at once. The language with the
shortest code for the whole text wins; the score is its share of the probabilities 2^-bits of all
languages with equal priors.

The trees are learned from a bounded sample of labelled rows: per language the ``rows_per_language``
texts with the smallest hashes of their keys, and of a text of more than ``longest`` characters a piece of that
many, from a place that the hash chooses. So a language of long texts only is learned as well. All texts are scored whole.

Cases: NULL and texts without a letter are ``und`` with score 0, as is everything if nothing was
learned; equal code lengths go to the first language in code-point order; repeated rows get equal
results. Upper-case A-Z count as lower case. There is no shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitgauge.llm.texts import batch_like, raw, slices, with_struct
from hitgauge.staging import attach, stage

UNKNOWN = "und"
#: What stands before a text, so that its first bytes have contexts as well.
START = b" "


def codes(text: bytes, order: int) -> np.ndarray:
    """For each byte of the text the number made of its ``order`` predecessors and itself."""
    data = np.frombuffer(START * order + text.lower(), np.uint8).astype(np.uint64)
    n = len(data) - order
    out = np.zeros(n, np.uint64)
    for i in range(order + 1):
        out = (out << np.uint64(8)) | data[i : i + n]
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, is there) of each wanted code in sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Trees:
    """Costs in bits, per order: of a byte after a context, and of the escape from a context."""

    languages: list[str]
    order: int
    bytes_: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]

    def cost(self, order: int, wanted: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each code after its first ``order`` bytes, a column per language."""
        if order < 0:
            return np.full((len(wanted), len(self.languages)), 8.0, np.float32)
        keys, table = self.bytes_[order]
        at, there = _find(keys, wanted)
        out = table[at] if len(keys) else np.empty((len(wanted), len(self.languages)), np.float32)
        if not there.all():
            out[~there] = self.missing(order, wanted[~there])
        return out

    def missing(self, order: int, wanted: np.ndarray) -> np.ndarray:
        lower = wanted & np.uint64(256**order - 1)
        out = self.cost(order - 1, lower)
        keys, table = self.escapes[order]
        at, there = _find(keys, wanted >> np.uint64(8))
        out[there] += table[at[there]]
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        parts = [codes(t, self.order) for t in texts]
        costs = self.cost(self.order, np.concatenate(parts)) if parts else np.zeros((0, len(self.languages)))
        ends = np.cumsum([len(p) for p in parts])
        return np.array([
            costs[end - len(part) : end].sum(axis=0, dtype=np.float64) for part, end in zip(parts, ends)
        ]).reshape(len(texts), len(self.languages))


def grow(languages: list[str], order: int, language: np.ndarray, code: np.ndarray, count: np.ndarray) -> Trees:
    """Trees from counts of codes of ``order`` + 1 bytes; shorter contexts follow by summing."""
    trees = Trees(languages, order, [], [])
    for k in range(order + 1):
        short = code & np.uint64(256 ** (k + 1) - 1)
        keys, place = np.unique(short, return_inverse=True)
        counts = np.zeros((len(keys), len(languages)))
        np.add.at(counts, (place, language), count)
        contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, distinct = (np.zeros((len(contexts), len(languages))) for _ in range(2))
        np.add.at(total, of, counts)
        np.add.at(distinct, of, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2((total + distinct) / distinct), 0.0)
            seen = np.log2((total[of] + distinct[of]) / counts)
        trees.escapes.append((contexts, escape.astype(np.float32)))
        trees.bytes_.append((np.zeros(0, np.uint64), np.zeros((0, len(languages)), np.float32)))
        table = np.where(counts > 0, seen, trees.missing(k, keys)).astype(np.float32)
        trees.bytes_[k] = (keys, table)
    return trees


def learn(
    labelled: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    order: int = 3,
    rows_per_language: int = 500,
    longest: int = 20_000,
) -> Trees:
    """Trees from the sample described above. What comes to the driver are the sample's distinct codes."""
    draw, size = F.xxhash64(key), F.char_length(text)
    place = F.pmod(F.xxhash64(draw), size - longest + 1) + 1
    piece = F.when(size > longest, F.substr(F.col(text), place.cast("int"), F.lit(longest))).otherwise(F.col(text))
    rows = labelled.filter(F.octet_length(text) > 0).select(
        F.col(lang).cast("string").alias("lang"), piece.alias("text"), draw.alias("draw")
    ).filter(F.col("lang").isNotNull())
    # a first cut by the expected share leaves few more rows per language than wanted, whatever its size
    sizes = stage(rows.groupBy("lang").agg(F.count("*").alias("rows")), "language-sizes")
    near = rows_per_language + 10 * rows_per_language**0.5 + 10
    share = F.pmod(F.col("draw"), F.lit(1 << 30)) / float(1 << 30)
    rows = attach(rows.withColumn("share", share), sizes, ["lang"]).filter(F.col("share") * F.col("rows") <= near)
    first = Window.partitionBy("lang").orderBy("share", "draw")
    drawn = rows.select("lang", "share", "draw").withColumn("n", F.row_number().over(first))
    cut = drawn.filter(F.col("n") <= rows_per_language).groupBy("lang").agg(F.max(F.struct("share", "draw")).alias("last"))
    sample = attach(rows, stage(cut, "language-sample"), ["lang"]).filter(F.struct("share", "draw") <= F.col("last"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = raw(batch, "text")
            for name in sorted(set(langs)):
                own = np.concatenate([codes(t, order) for t, x in zip(texts, langs) if x == name])
                found, n = np.unique(own, return_counts=True)
                yield batch_like({
                    "lang": pa.array([name] * len(found), pa.string()),
                    "code": pa.array(found.astype(np.int64)),
                    "n": pa.array(n.astype(np.int64)),
                })

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, code bigint, n bigint")
    table = counts.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(table.column("lang").to_pylist(), object)
    languages = sorted(set(names))
    number = {x: i for i, x in enumerate(languages)}
    return grow(
        languages,
        order,
        np.array([number[x] for x in names], np.int64),
        table.column("code").to_numpy().astype(np.uint64),
        table.column("n").to_numpy().astype(np.float64),
    )


def _has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def predict(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """(_doc, lang_pred, score): every row of ``docs`` as a struct, and its language."""
    packed = with_struct(docs, "_doc").withColumn("_text", F.col(f"_doc.`{text}`"))
    held = docs.sparkSession.sparkContext.broadcast(trees)
    size = max(1 << 16, (4 << 20) // max(1, len(trees.languages)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in slices(batches, "_text", size):
            texts = raw(batch, "_text")
            best, score = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
            known = np.flatnonzero([_has_letter(t) for t in texts]) if model.languages else []
            if len(known):
                bits = model.bits([texts[i] for i in known])
                best[known] = bits.argmin(axis=1)
                score[known] = 1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
            yield batch_like({
                "_doc": batch.column("_doc"),
                "lang_pred": pa.array(names[best], pa.string()),
                "score": pa.array(score),
            })

    kind = packed.schema["_doc"].dataType.simpleString()
    return packed.mapInArrow(work, f"_doc {kind}, lang_pred string, score double")
