"""Token-id files: whole texts as ids of a public tokenizer, in range-ANS blocks.

A set of files is a folder with ``table`` (the shared frequencies, one row per id), ``parts`` (tokens before
each part) and ``blocks/part=n`` (coded blocks with the ids and lengths of their documents). Parts are
ranges of the document id in ascending order, and so are the rows of their blocks; blocks hold whole
documents and about ``BLOCK_TOKENS`` ids, and can be decoded one by one and from any checkpoint
(``rans``). All are tables that Spark's committer writes, so a task that is retried leaves no half file, in
any store.

Texts are shuffled once, into ranges of the id. Their ids are staged, counted into the shared table (a row
per id of the vocabulary comes to the driver) and coded.

With ``by_word``, white space as in ``[\\x20\\x09-\\x0D]`` must end any token of the tokenizer, so that a
text's ids are those of its words one after the other; a worker then remembers the words it has coded
(up to ``HELD_WORDS``) until it serves another step. Texts with one of the tokenizer's added tokens in them, and all texts without
``by_word``, are handed over whole.

Cases: NULL and empty texts have the end id only; NULL document ids come first; rows that repeat an id are
all kept, next to each other, by the hash of their text; a document longer than a block is a block; no
documents give no blocks.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitgauge.llm import rans
from hitgauge.llm.texts import batch_like, kept, let_go, numbered, raw, slices
from hitgauge.staging import stage

BLOCK_TOKENS = 1 << 20
#: Words that a worker remembers, and the longest of them in bytes.
HELD_WORDS, HELD_BYTES = 600_000, 48
#: Words whose ids are asked for in one call.
CALL_WORDS = 16_000
#: Words that can be split at the end of their letters, if the tokenizer does so as well.
TAIL = ".,!?;:"
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
LETTERS = re.compile(f"([{ALPHABET}]+)([{TAIL}]*)")


def _tokenizer(file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(file)


def _encode_words(tokenizer, words: list[bytes], kind: str, mark: tuple[str, int]) -> list[bytes]:
    """The ids of each word. Many words are one call: a special token between them parts their ids."""
    name, number = mark
    out: list[bytes] = []
    for at in range(0, len(words), CALL_WORDS):
        part = words[at : at + CALL_WORDS]
        joined = [name.join(w.decode("utf-8", "replace") for w in part[i : i + 1000]) for i in range(0, len(part), 1000)]
        for found in tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(found.ids, kind)
            data, width = ids.tobytes(), ids.itemsize
            cuts = (np.flatnonzero(ids == number) * width).tolist()
            out += [data[a:b] for a, b in zip([0, *(c + width for c in cuts)], [*cuts, len(data)])]
    return out


def letter_forms(tokenizer) -> dict[int, str] | None:
    """How the model spells each letter, if a run of letters is one piece for it, whatever follows; else None."""
    forms = {}
    for letter in ALPHABET:
        pieces = tokenizer.pre_tokenizer.pre_tokenize_str(letter) if tokenizer.pre_tokenizer else [(letter, None)]
        forms[ord(letter)] = "".join(p for p, _ in pieces)
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    model = lambda text: [t.id for t in tokenizer.model.tokenize(text.translate(forms))]
    probes = ["a", "the", "thequickbrownfox", "jumpsoverthelazydog", ALPHABET, ALPHABET[::-1]]
    same = all(
        ids(w) == model(w) and ids(w + p) == model(w) + ids(p) and ids(w.replace("ß", "").upper().replace("Ÿ", "ÿ")) == model(w.replace("ß", ""))
        for w in probes
        for p in (*TAIL, "...", "!!", ",.")
    )
    return forms if same else None


def _encode_new(
    tokenizer, words: list[bytes], kind: str, mark: tuple[str, int], forms: dict[int, str] | None, known: dict[bytes, bytes]
) -> list[bytes]:
    """The ids of words that are not yet known; runs of letters go straight to the tokenizer's model."""
    out: list[bytes] = [b""] * len(words)
    code = np.dtype(kind).char  # of the array module as well
    tokenize, tails, rest = tokenizer.model.tokenize, {"": b""}, []
    for i, word in enumerate(words):
        found = LETTERS.fullmatch(word.decode("utf-8", "replace").lower()) if forms else None
        if found is None:
            rest.append(i)
            continue
        core, tail = found.groups()
        if tail not in tails:
            tails[tail] = _encode_words(tokenizer, [tail.encode()], kind, mark)[0]
        ids = known.get(core.encode()) or array(code, [t.id for t in tokenize(core.translate(forms))]).tobytes()
        out[i] = ids + tails[tail]
    if rest:
        for i, ids in zip(rest, _encode_words(tokenizer, [words[i] for i in rest], kind, mark)):
            out[i] = ids
    return out


def encode_texts(
    tokenizer, texts: list[bytes], kind: str, by_word: bool, forms: dict[int, str] | None = None,
    known: dict[bytes, bytes] | None = None,
) -> list[bytes]:
    """The ids of each text, as numbers of type ``kind`` one after the other; words are added to the ``known`` ones."""
    known = {} if known is None else known
    added = tokenizer.get_added_tokens_decoder()
    marks = [(t.content, i) for i, t in sorted(added.items()) if t.special and not (t.lstrip or t.rstrip or t.single_word)]
    names = [t.content.encode() for t in added.values()]
    plain = [by_word and bool(marks) and not any(n in t for n in names) for t in texts]
    whole = [t.decode("utf-8", "replace") for t, p in zip(texts, plain) if not p]
    rest = iter([np.array(e.ids, kind).tobytes() for e in tokenizer.encode_batch(whole, add_special_tokens=False)])
    words, own, sizes = numbered([t if p else b"" for t, p in zip(texts, plain)])
    coded = list(map(known.get, words))
    new = [i for i, c in enumerate(coded) if c is None]
    if new:
        fresh = _encode_new(tokenizer, [words[i] for i in new], kind, marks[0], forms, known)
        for i, ids in zip(new, fresh):
            coded[i] = ids
            if len(known) < HELD_WORDS and len(words[i]) <= HELD_BYTES:
                known[words[i]] = ids
    ends = np.cumsum(sizes).tolist()
    spell = coded.__getitem__
    return [b"".join(map(spell, own[b - n : b].tolist())) if p else next(rest) for b, n, p in zip(ends, sizes.tolist(), plain)]


def tokenised(
    docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", by_word: bool = True
) -> tuple[DataFrame, int]:
    """((part, start, id, n_tokens, ids), size of the vocabulary); ``start`` counts from the part's first token."""
    with open(tokenizer, encoding="utf-8") as f:
        file = f.read()
    vocabulary = max(max(_tokenizer(file).get_vocab().values(), default=0), end_id) + 1
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(file)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    ranged = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    end, width = np.array([end_id], kind).tobytes(), np.dtype(kind).itemsize
    forms = letter_forms(_tokenizer(file)) if by_word else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, model = TaskContext.get().partitionId(), 0, _tokenizer(held.value)
        step = f"words as {kind} {zlib.crc32(held.value.encode())}"
        for batch in slices(batches, "text", step=step):
            ids = [x + end for x in encode_texts(model, raw(batch, "text"), kind, by_word, forms, kept(step))]
            n = np.array([len(x) // width for x in ids], np.int64)
            yield batch_like({
                "part": pa.array(np.full(len(n), part, np.int32)),
                "start": pa.array(start + np.cumsum(n) - n),
                "id": batch.column("id"),
                "n_tokens": pa.array(n),
                "ids": pa.array(ids, pa.binary()),
            })
            start += int(n.sum())

    id_kind = rows.schema["id"].dataType.simpleString()
    done = ranged.mapInArrow(work, f"part int, start bigint, id {id_kind}, n_tokens bigint, ids binary")
    return stage(done, "token-ids"), vocabulary


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", by_word: bool = True
) -> None:
    """Write the files of all ``docs`` to a new folder."""
    spark = docs.sparkSession
    tokens, vocabulary = tokenised(docs, tokenizer, end_id, key, text, by_word)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            column = batch.column("ids")
            first, last = (column.offset, column.offset + len(column))
            edges = np.frombuffer(column.buffers()[1], np.int32)[[first, last]]
            numbers = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0] : edges[1]].view(kind)
            for at in range(0, len(numbers), 1 << 22):  # the values of a batch lie one after the other
                total += np.bincount(numbers[at : at + (1 << 22)], minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield batch_like({"token": pa.array(seen), "n": pa.array(total[seen])})

    counted = tokens.select("ids").mapInArrow(count, "token bigint, n bigint")
    counted = counted.groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary, np.int64)
    counts[counted.column("token").to_numpy()] = counted.column("n").to_numpy()
    table = rans.table_from_counts(counts)
    spark.createDataFrame(
        pa.table({"token": pa.array(np.arange(vocabulary)), "frequency": pa.array(table.freq.astype(np.int64))})
    ).coalesce(1).write.parquet(f"{path}/table")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    totals.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/parts")
    held = spark.sparkContext.broadcast(table)
    id_kind = tokens.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        now: dict = {"part": -1, "start": 0, "n": 0, "ids": [], "docs": [], "sizes": []}

        def block() -> Iterator[pa.RecordBatch]:
            if now["docs"]:
                numbers = np.frombuffer(b"".join(now["ids"]), kind).astype(np.int64)
                yield batch_like({
                    "part": pa.array([now["part"]], pa.int32()),
                    "start": pa.array([now["start"]], pa.int64()),
                    "n_tokens": pa.array([now["n"]], pa.int64()),
                    "ids": pa.array([now["docs"]], pa.list_(now["kind"])),
                    "sizes": pa.array([now["sizes"]], pa.list_(pa.int64())),
                    "coded": pa.array([rans.encode(numbers, held.value)], pa.binary()),
                })

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "start", "id", "n_tokens", "ids")]
            for part, start, doc, n, ids in zip(*columns):
                goes_on = part == now["part"] and start == now["start"] + now["n"]
                if not goes_on or (now["n"] and now["n"] + n > BLOCK_TOKENS):
                    yield from block()
                    now = {"part": part, "start": start, "n": 0, "ids": [], "docs": [], "sizes": []}
                now["kind"] = batch.column("id").type
                now["n"] += n
                now["ids"].append(ids)
                now["docs"].append(doc)
                now["sizes"].append(n)
        yield from block()

    coded = tokens.mapInArrow(
        work, f"part int, start bigint, n_tokens bigint, ids array<{id_kind}>, sizes array<bigint>, coded binary"
    )
    coded.write.partitionBy("part").parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> rans.Table:
    rows = spark.read.parquet(f"{path}/table").toArrow().sort_by("token")
    freq = rows.column("frequency").to_numpy()
    return rans.Table(freq, int(freq.sum()).bit_length() - 1)


def read(spark: SparkSession, path: str, id_type: str = "bigint", with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids): every document of a folder, decoded block by block.

    ``start`` is the number of ids of all documents before it; ``ids`` is NULL unless ``with_ids``.
    """
    held = spark.sparkContext.broadcast(read_table(spark, path))
    stored = f"part int, start bigint, n_tokens bigint, ids array<{id_type}>, sizes array<bigint>, coded binary"
    blocks = spark.read.schema(stored).parquet(f"{path}/blocks").drop("n_tokens")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "coded", 1):
            numbers = rans.decode(batch.column("coded")[0].as_py(), held.value).astype("<u4")
            sizes = np.array(batch.column("sizes")[0].as_py(), np.int64)
            if sizes.sum() != len(numbers):
                raise ValueError("a block's documents do not add up")
            ends = np.cumsum(sizes)
            own = [numbers[b - n : b] for b, n in zip(ends, sizes)]
            yield batch_like({
                "part": pa.array(np.full(len(sizes), batch.column("part")[0].as_py(), np.int32)),
                "start": pa.array(batch.column("start")[0].as_py() + ends - sizes),
                "id": batch.column("ids")[0].values,
                "n_tokens": pa.array(sizes),
                "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(numbers.astype(np.int32)))
                if with_ids else pa.nulls(len(sizes), pa.list_(pa.int32())),
            })

    decoded = blocks.mapInArrow(
        work, f"part int, start bigint, id {id_type}, n_tokens bigint, ids_crc32 bigint, ids array<int>"
    )
    parts = spark.read.parquet(f"{path}/parts").select("part", "before")
    return decoded.join(parts, "part").select(
        "id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )
