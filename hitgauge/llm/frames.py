"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames of at most ``frame_bytes`` bytes, cut between code points, each with the
number of units that begin in it; the running sum of these counts tells which frame holds the start of a
unit. A unit is a run of letters A-Z, a-z or any other single code point; a run may go on in the next frame. A
store is a table with a row per document: its id, its counts and its frames in order.

For an infill the two cuts are unit numbers. Only the frames that hold a cut are decompressed, split and compressed
again; all others are moved as they are, between frames that hold the control strings. The result is again a
sequence of frames, so outputs are read like stored texts: one frame at a time, in order. A text is put
together again from output and form alone: the control strings are searched in the stream, and the frames between
them are read in the order of the text. A task holds one row's compressed frames and one frame of text besides.

The store is written in the shared folder and needs no shuffle; whatever share of the rows has one key or source,
rows stay where they were scanned. ``write_store`` and ``infill`` take any table; other columns travel in a struct, so
no name can clash.

Cases: a NULL text is the empty text, which has no frame and no unit and stays plain; a text with a control string is
plain, so that its output can be read back; NULL ids hash as the empty string; rows that repeat an id are cut by the same
numbers, each in its own text; an empty table gives empty tables; a long text has many frames, and a unit longer
than a frame spans several.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitgauge.llm.texts import batch_like, raw, slices

#: Control strings before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CONTROL = (PREFIX, SUFFIX, MIDDLE)
FRAME_BYTES = 64 << 10
LEVEL = 1
FRAMES = "array<struct<units:bigint,chars:bigint,data:binary>>"
FRAME_TYPE = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())])


@functools.cache
def _packer(level: int) -> tuple:
    return zstandard.ZstdCompressor(level=level).compress, zstandard.ZstdDecompressor().decompress


def unit_starts(text: np.ndarray, inside: bool = False) -> np.ndarray:
    """Whether a unit starts at each byte; ``inside`` if the byte before is a letter."""
    letter = ((text | 32) - 97) < 26
    before = np.empty_like(letter)
    before[:1], before[1:] = inside, letter[:-1]
    return ((text & 0xC0) != 0x80) & ~(letter & before)


def cut_frames(text: bytes, size: int = FRAME_BYTES, level: int = LEVEL) -> list[tuple[int, int, bytes]]:
    """(units that start in it, code points, compressed bytes) of each frame."""
    pack, (at, inside, frames) = _packer(level)[0], (0, False, [])
    while at < len(text):
        to = min(len(text), at + size)
        while to < len(text) and text[to] & 0xC0 == 0x80:
            to -= 1
        own = text[at:to]
        values = np.frombuffer(own, np.uint8)
        starts = unit_starts(values, inside)
        frames.append((int(starts.sum()), int(((values & 0xC0) != 0x80).sum()), pack(own)))
        inside, at = bool(unit_starts(values[-1:])[0] and not unit_starts(values[-1:], True)[0]), to
    return frames


def _arrays(rows: list[list[tuple[int, int, bytes]]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = [f for row in rows for f in row]
    parts = [pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(FRAME_TYPE)))


def _rows(column: pa.ListArray) -> Iterator[list[tuple[int, int, bytes]]]:
    """Frames of each row of a batch, one row at a time."""
    for frames in column:
        values = frames.values
        if values is None:
            yield []
        else:
            yield list(zip(*[values.field(i).to_pylist() for i in range(3)]))


def write_store(docs: DataFrame, path: str, text: str = "text", frame_bytes: int = FRAME_BYTES) -> None:
    """Write a store of ``docs``: all columns but the text as struct ``doc``, ``n_units``, ``n_chars``, ``has_control``, ``frames``.

    Parquet leaves the frames uncompressed, because they are compressed already.
    """
    packed = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("doc"), F.col(text).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = raw(batch, "_text")
            rows = [cut_frames(t, frame_bytes) for t in texts]
            yield batch_like({
                "doc": batch.column("doc"),
                "n_units": pa.array([sum(f[0] for f in row) for row in rows], pa.int64()),
                "n_chars": pa.array([sum(f[1] for f in row) for row in rows], pa.int64()),
                "has_control": pa.array([any(c in t for c in CONTROL) for t in texts], pa.bool_()),
                "frames": _arrays(rows),
            })

    kind = packed.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, n_units bigint, n_chars bigint, has_control boolean, frames {FRAMES}"
    packed.mapInArrow(work, schema).write.option("compression", "uncompressed").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _hash_numbers(key: Column, seed: str) -> list[Column]:
    """The first four 8-digit groups of a key's hex digest as numbers."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def planned(store: DataFrame, key: str, seed: str = "1:", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """The store with ``form`` (plain, psm or spm) and the unit numbers ``low`` and ``high`` of the cuts.

    All three follow from the key alone, and from the number of units.
    """
    one, two, three, four = _hash_numbers(F.col(f"doc.{key}"), seed)
    cuts = [h % (F.col("n_units") + 1) for h in (one, two)]
    plain = (F.col("n_units") == 0) | F.col("has_control") | (three % 100 >= plain_from)
    return store.withColumns({
        "form": F.when(plain, "plain").when(four % 100 < spm_below, "spm").otherwise("psm"),
        "low": F.least(*cuts), "high": F.greatest(*cuts),
    })


def split_at(frames: list[tuple[int, int, bytes]], unit: int, level: int = LEVEL) -> tuple[list, list]:
    """Frames before the start of a unit and from it on; only the frame that holds the start is decompressed."""
    pack, unpack = _packer(level)
    total = 0
    for i, (units, chars, data) in enumerate(frames):
        if unit < total + units:
            text = unpack(data)
            values = np.frombuffer(text, np.uint8)
            # whether the frame begins inside a run of letters is what its own count tells
            starts = unit_starts(values)
            if starts.sum() != units:
                starts = unit_starts(values, True)
            at = int(np.flatnonzero(starts)[unit - total])
            if at == 0:
                return frames[:i], frames[i:]
            own = int(((values[:at] & 0xC0) != 0x80).sum())
            left, right = (unit - total, own, pack(text[:at])), (units - unit + total, chars - own, pack(text[at:]))
            return [*frames[:i], left], [right, *frames[i + 1 :]]
        total += units
    return frames, []


def _control(said: bytes) -> tuple[int, int, bytes]:
    return cut_frames(said)[0]


def arranged(frames: list, form: str, low: int, high: int) -> tuple[list, int, int]:
    """(frames of the output, code points of the prefix, and of the middle)."""
    rest, suffix = split_at(frames, high)
    prefix, middle = split_at(rest, low)
    before, after, between = map(_control, CONTROL)
    if form == "psm":
        out = [before, *prefix, after, *suffix, between, *middle]
    else:
        out = [after, *suffix, before, *prefix, between, *middle]
    return out, sum(f[1] for f in prefix), sum(f[1] for f in middle)


def infill(store: DataFrame, key: str, **options) -> DataFrame:
    """(doc, n_units, form, prefix_chars, middle_chars, frames): the frames of each document's output, in order.

    The character counts are NULL for plain documents.
    """
    plans = planned(store, key, **options).select("doc", "n_units", "form", "low", "high", "frames")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            forms, low, high = (batch.column(c).to_pylist() for c in ("form", "low", "high"))
            rows, sizes = [], []
            for i, frames in enumerate(_rows(batch.column("frames"))):
                made = (frames, None, None) if forms[i] == "plain" else arranged(frames, forms[i], low[i], high[i])
                rows.append(made[0])
                sizes.append(made[1:])
            yield batch_like({
                "doc": batch.column("doc"), "n_units": batch.column("n_units"), "form": batch.column("form"),
                "prefix_chars": pa.array([s[0] for s in sizes], pa.int64()),
                "middle_chars": pa.array([s[1] for s in sizes], pa.int64()), "frames": _arrays(rows),
            })

    kind = plans.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, n_units bigint, form string, prefix_chars bigint, middle_chars bigint, frames {FRAMES}"
    return plans.mapInArrow(work, schema)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def find_control(frames: list, said: list[bytes]) -> list[int]:
    """Byte places of the control strings in the stream of frames, each the first one after the one before."""
    unpack, places = _packer(LEVEL)[1], []
    tail, at = b"", 0  # the last bytes of the stream so far, so that a string may lie across frames
    for _, _, data in frames:
        text, base = tail + unpack(data), at - len(tail)
        start = 0
        while len(places) < len(said) and (found := text.find(said[len(places)], start)) >= 0:
            places.append(base + found)
            start = found + len(said[len(places) - 1])
        at = base + len(text)
        tail = text[max(start, len(text) - max(map(len, said)) + 1) :]
    return places


def stream(frames: list, parts: list[tuple[int, int | None]] | None = None) -> Iterator[bytes]:
    """The text of the frames one after the other, or of byte ranges of it in the order given."""
    unpack = _packer(LEVEL)[1]
    for low, high in parts or [(0, None)]:
        at = 0
        for _, _, data in frames:
            size = zstandard.frame_content_size(data)
            begin, end = max(low - at, 0), size if high is None else min(high - at, size)
            if begin < end:
                text = unpack(data)
                yield text if (begin, end) == (0, size) else text[begin:end]
            at += size


def text_order(frames: list, form: str) -> list[tuple[int, int | None]] | None:
    """Byte ranges of an output that give the text, in its order."""
    if form == "plain":
        return None
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    first, second, third = find_control(frames, list(order))
    one, two, rest = (first + 3, second), (second + 3, third), (third + 3, None)
    return [one, rest, two] if form == "psm" else [two, rest, one]


def output_texts(outputs: DataFrame) -> DataFrame:
    """(doc, form, output, restored): outputs of :func:`infill` and the texts rebuilt from them as strings."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, 64):
            forms = batch.column("form").to_pylist()
            said, text = [], []
            for form, frames in zip(forms, _rows(batch.column("frames"))):
                said.append(b"".join(stream(frames)).decode())
                text.append(b"".join(stream(frames, text_order(frames, form))).decode())
            yield batch_like({
                "doc": batch.column("doc"), "form": batch.column("form"),
                "output": pa.array(said, pa.string()), "restored": pa.array(text, pa.string()),
            })

    kind = outputs.schema["doc"].dataType.simpleString()
    return outputs.mapInArrow(work, f"doc {kind}, form string, output string, restored string")


def digests(outputs: DataFrame) -> DataFrame:
    """Outputs of :func:`infill` with SHA-256 of output and of rebuilt text in place of their frames."""
    kept = [c for c in outputs.columns if c != "frames"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            forms = batch.column("form").to_pylist()
            said, text = [], []
            for form, frames in zip(forms, _rows(batch.column("frames"))):
                for found, parts in ((said, None), (text, text_order(frames, form))):
                    running = hashlib.sha256()
                    for piece in stream(frames, parts):
                        running.update(piece)
                    found.append(running.hexdigest())
            yield batch_like({
                **{c: batch.column(c) for c in kept}, "output_sha256": pa.array(said), "restored_sha256": pa.array(text),
            })

    fields = ", ".join(f"{c} {outputs.schema[c].dataType.simpleString()}" for c in kept)
    return outputs.mapInArrow(work, f"{fields}, output_sha256 string, restored_sha256 string")
