"""Words of whole texts, cut inside a Python worker from the bytes of many texts at once: no object is made for a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import _ACCENTED, _PLAIN
from brindle.shipping import by_value

by_value(__name__)

#: Texts that are cut at once, so that a worker's memory follows neither the batch nor the table.
TEXTS = 512
SEPARATOR, WORD, MARK = 0, 1, 2
_STEP = 2048
#: The ASCII letter that stands for a code point when texts are folded, or 0.
LETTERS = np.zeros(0x110000, np.uint8)
LETTERS[[ord(c) for c in _ACCENTED]] = [ord(c) for c in _PLAIN]
_alphabets: dict[str, np.ndarray] = {}


def lowered(c: Column | str) -> Column:
    """What :func:`cut` takes: texts in lower case by Spark, a missing one empty."""
    return F.lower(F.coalesce(c, F.lit("")))


def alphabet(spark: SparkSession) -> np.ndarray:
    """For every code point whether it separates words, belongs to one or is a mark, asked of Spark's own regular expressions."""
    key = spark.sparkContext.applicationId
    if key not in _alphabets:
        starts = [a for a in range(0, 0x110000, _STEP) if a != 0xD800]  # surrogates are no characters
        every = spark.createDataFrame([(a, "".join(map(chr, range(a, a + _STEP)))) for a in starts], "a int, s string")
        kinds = np.full(0x110000, SEPARATOR, np.uint8)
        for a, word, mark in every.select("a", F.regexp_replace("s", r"[^\p{L}\p{N}_]", " "), F.regexp_replace("s", r"\P{Mn}", " ")).collect():
            for kind, text in ((WORD, word), (MARK, mark)):
                kinds[a : a + _STEP][np.frombuffer(text.encode("utf-32-le"), np.uint32) != 32] = kind
        _alphabets[key] = kinds
    return _alphabets[key]


def cut(column: pa.Array, kinds: np.ndarray, letters: np.ndarray | None = None) -> pa.ListArray:
    """The words of each text, in order. Texts already cut stay.

    A mark ends a word; with ``letters`` texts are folded as by :func:`brindle.functions.text.fold`: marks fall out, and letters
    with marks become those without.
    """
    if pa.types.is_list(column.type):
        return column
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    n, buffers = len(column), column.buffers()
    at = np.frombuffer(buffers[1], np.int32, n + 1, column.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8, at[-1] - at[0], at[0]) if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    is_word = kinds[:256].copy()
    is_word[128:] = WORD  # bytes of longer characters, of which some are taken out below
    word = is_word[data] == WORD
    gone = None
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        point = data[lead].astype(np.int32) & (0x7F >> size)
        for i in range(1, 4):
            some = size > i
            point[some] = (point[some] << 6) | (data[lead[some] + i] & 0x3F)
        kind = kinds[point]
        for i in range(4):
            word[lead[(size > i) & (kind != WORD)] + i] = False
        if letters is not None and ((kind == MARK) | (letters[point] > 0)).any():
            gone, data = np.zeros(len(data), bool), data.copy()
            gone[lead[kind == MARK]] = True
            less = (kind == MARK) | (letters[point] > 0)
            for i in range(1, 4):
                gone[lead[(size > i) & less] + i] = True
            data[lead[letters[point] > 0]] = letters[point[letters[point] > 0]]
    if gone is not None:
        at = np.concatenate([[0], np.cumsum(~gone)])[at]
        data, word = data[~gone], word[~gone]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = word[first]  # a text's first byte goes on with no word of the text before
    starts = np.flatnonzero(begins)
    kept = data[word]
    ends = np.append(np.flatnonzero(begins[word]), len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(kept))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, at).astype(np.int32)), words)
