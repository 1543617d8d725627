"""Deterministic hash embeddings, as rows of non-zero components or as dense arrays. A text is folded inside its own row: nothing is shuffled."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.words import TEXTS as ROWS
from brindle.functions.words import alphabet, cut, lowered
from brindle.shipping import by_value

by_value(__name__)

WIDTH, LEAST = 256, 1e-6
#: What a worker knows of tokens that it has met (tokens, places, weights), and how many it keeps.
_known: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
MOST_KNOWN = 200_000


def _digests(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens' places before the width is applied, and their signed weights; only new tokens are hashed."""
    known = _known[0] if _known else (tokens.slice(0, 0), np.zeros(0, np.int64), np.zeros(0))
    at = pc.index_in(tokens, value_set=known[0])
    met, at = at.is_valid().to_numpy(zero_copy_only=False), at.fill_null(0).to_numpy()
    place, weight = np.zeros(len(tokens), np.int64), np.zeros(len(tokens))
    place[met], weight[met] = known[1][at[met]], known[2][at[met]]
    new = tokens.filter(pa.array(~met))
    if len(new):
        h = np.frombuffer(b"".join(hashlib.sha256(t).digest() for t in new.cast(pa.binary()).to_pylist()), np.uint8).reshape(-1, 32)
        place[~met] = h[:, :4].copy().view(">u4")[:, 0]
        weight[~met] = np.where(h[:, 4] % 2 == 0, 1.0, -1.0) * (1.0 + h[:, 5] / 255.0)
        if len(known[0]) + len(new) > MOST_KNOWN:
            _known[:] = [(tokens, place, weight)]
        else:
            _known[:] = [(pa.concat_arrays([known[0], new]), np.append(known[1], place[~met]), np.append(known[2], weight[~met]))]
    return place, weight


def embed(tokens: list[str] | None, width: int = WIDTH) -> np.ndarray:
    """The unit-length signed sum over token digests; without tokens 1e-6 at 0."""
    return _fold(pa.array([tokens or []], pa.list_(pa.string())), width)[0][0]


def _fold(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of rows of tokens, and which of their components some token falls on; a token is looked up once for all rows."""
    n, lens = len(column), np.diff(column.offsets.to_numpy())
    coded = column.flatten().dictionary_encode()
    place, weight = _digests(coded.dictionary)
    place = place % width
    token = coded.indices.to_numpy(zero_copy_only=False)
    cell = np.repeat(np.arange(n), lens) * width + place[token]
    out = np.bincount(cell, weight[token], n * width).reshape(n, width)
    hit = np.zeros(n * width, bool)
    hit[cell] = True
    hit = hit.reshape(n, width)
    none = lens == 0
    out[none, 0], hit[none, 0] = LEAST, True
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, where=norm > 1e-5, out=out), hit


def _rows(rows: DataFrame, key: str, text: str, fold, schema: str) -> DataFrame:
    kinds = rows.sparkSession.sparkContext.broadcast(alphabet(rows.sparkSession))

    def pieces(batches):
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                piece = b.slice(i, ROWS)
                yield fold(piece.column(0), cut(piece.column(1), kinds.value))

    return rows.select(key, lowered(text).alias("text")).mapInArrow(pieces, schema)


def components(rows: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """``(key, idx, value)``: the components that some token falls on."""

    def fold(keys: pa.Array, tokens: pa.ListArray) -> pa.RecordBatch:
        vectors, hit = _fold(tokens, width)
        at, idx = np.nonzero(hit)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(idx.astype(np.int32)), pa.array(vectors[at, idx])], names=[key, "idx", "value"])

    return _rows(rows, key, text, fold, f"{key} {rows.schema[key].dataType.simpleString()}, idx int, value double")


def vectors(rows: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """``(key, vector)``: dense embeddings."""

    def fold(keys: pa.Array, tokens: pa.ListArray) -> pa.RecordBatch:
        flat = _fold(tokens, width)[0].ravel()
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, width, np.int32), flat)], names=[key, "vector"])

    return _rows(rows, key, text, fold, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<double>")
