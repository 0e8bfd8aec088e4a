"""Texts to vectors.

An encoder is a function ``(DataFrame, text column) -> DataFrame`` that adds an ``embedding``
column of ARRAY<FLOAT>. :func:`batch_encoder` makes one from any Python model that encodes a list
of texts; :func:`hashed_token_encoder` is the model-free default.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitgauge.functions.vectors import dims as vector_dims
from hitgauge.functions.vectors import normalize as normalize_vector
from hitgauge.operators.models import once_per_worker
from hitgauge.staging import stage

Encoder = Callable[[DataFrame, str], DataFrame]
Model = Callable[[Sequence[str]], "np.ndarray"]

HASHED_DIMS = 256
#: Bytes of text that are cut into tokens at once; a longer text comes alone.
TOKEN_BYTES = 8 << 20


def _blank_separators(texts: pa.Array) -> pa.Array:
    """Every byte that is not in ``[a-z0-9]`` as a space; multi-byte characters become spaces too."""
    codes = np.arange(256)
    kept = ((codes >= ord("a")) & (codes <= ord("z"))) | ((codes >= ord("0")) & (codes <= ord("9")))
    table = np.where(kept, codes, ord(" ")).astype(np.uint8)
    _, offsets, data = texts.buffers()
    blanked = table[np.frombuffer(data or b"", dtype=np.uint8)]
    return type(texts).from_buffers(len(texts), offsets, pa.py_buffer(blanked), offset=texts.offset)


def _token_hash(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:6], 16) if token else -1


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, in pieces of at most ``TOKEN_BYTES``, or one text."""
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + TOKEN_BYTES, side="right")))
        yield texts.slice(at, to - at)
        at = to


def hashed_token_encoder(n_dims: int = HASHED_DIMS) -> Encoder:
    """Token counts per hash bucket.

    A token is a lower-cased run of ``[a-z0-9]``; its bucket is the first six md5 digits modulo
    ``n_dims``. Texts of ``TOKEN_BYTES`` are cut at once and each of their distinct tokens hashed once,
    which took a quarter of the time of hashing every token with the SQL functions.
    """

    def cells(texts: pa.Array) -> np.ndarray:
        n = len(texts)
        parts = pc.ascii_split_whitespace(_blank_separators(pc.utf8_lower(texts)))
        rows = np.repeat(np.arange(n, dtype=np.int64), np.diff(parts.offsets.to_numpy()))
        tokens = parts.flatten().dictionary_encode()
        hashes = np.array([_token_hash(t) for t in tokens.dictionary.to_pylist()], dtype=np.int64)
        hashes = hashes[tokens.indices.to_numpy()]
        real = hashes >= 0
        return np.bincount(rows[real] * n_dims + hashes[real] % n_dims, minlength=n * n_dims)

    @F.arrow_udf("array<float>")
    def counts(texts: pa.Array) -> pa.Array:
        n, at = len(texts), 0
        out = np.zeros(n * n_dims, dtype=np.float32)
        # A batch is bounded by rows and bytes, but what its tokens take is many times its bytes.
        for part in _pieces(texts.fill_null("")):
            out[at * n_dims : (at + len(part)) * n_dims] = cells(part)
            at += len(part)
        return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * n_dims, out)

    def encode(df: DataFrame, text_col: str) -> DataFrame:
        return df.withColumn("embedding", counts(F.col(text_col)))

    return encode


def batch_encoder(
    load_model: Callable[[], Model], batch_size: int = 512, normalize: bool = False
) -> Encoder:
    """Encoder from a Python model, loaded once per worker and called with ``batch_size`` texts.

    A NULL text is encoded as the empty text.
    """
    get_model = once_per_worker(load_model)

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = get_model()
        for texts in batches:
            texts = texts.fillna("")
            out: list[np.ndarray] = []
            for start in range(0, len(texts), batch_size):
                chunk = np.asarray(model(texts.iloc[start : start + batch_size].tolist()))
                out.extend(chunk.astype(np.float32))
            yield pd.Series(out, index=texts.index, dtype=object)

    def encode(df: DataFrame, text_col: str) -> DataFrame:
        encoded = df.withColumn("embedding", vectors(F.col(text_col)))
        if normalize:
            encoded = encoded.withColumn("embedding", normalize_vector(F.col("embedding")))
        return encoded

    return encode


def encode_rows(df: DataFrame, text_col: str, encoder: Encoder, normalize: bool = False) -> DataFrame:
    """Encode every row in place: no shuffle, a repeated text is encoded again."""
    encoded = encoder(df, text_col)
    if normalize:
        encoded = encoded.withColumn("embedding", normalize_vector(F.col("embedding")))
    return encoded


def encode_distinct(df: DataFrame, text_col: str, encoder: Encoder, normalize: bool = False) -> DataFrame:
    """One vector per distinct text, staged: a text with many copies is encoded once."""
    return stage(encode_rows(df.select(text_col).distinct(), text_col, encoder, normalize), "vectors")


def with_embeddings(df: DataFrame, text_col: str, vectors: DataFrame) -> DataFrame:
    """Rows with the vector of their text; rows without one keep a NULL embedding."""
    known = vectors.select(F.col(text_col).alias("_text"), "embedding")
    return df.join(known, df[text_col].eqNullSafe(known["_text"]), "left").drop("_text")


def vector_table(
    df: DataFrame, id_col: str, text_col: str, vector: str, prefix: str = "cache:", extras: Sequence[str] = ()
) -> DataFrame:
    """Documents of a vector index: ``key``, ``id`` (prefix and key), text, ``embedding``, extra fields."""
    return df.select(
        F.col(id_col).cast("long").alias("key"),
        F.concat(F.lit(prefix), F.col(id_col).cast("string")).alias("id"),
        F.col(text_col),
        F.col(vector).cast("array<float>").alias("embedding"),
        *extras,
    )


def dimension_check(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: number of vectors, smallest and largest dimension, and whether they agree."""
    size = vector_dims(F.col(vector))
    return df.agg(
        F.count(vector).alias("n_vectors"),
        F.min(size).alias("min_dim"),
        F.max(size).alias("max_dim"),
        (F.min(size) == F.max(size)).alias("same_dim"),
    )
