"""Hashes that Spark lacks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


#: Strings that are hashed side by side, and bytes of each that are laid out at once.
ROWS, BLOCK = 1024, 1 << 12


def fnv1a_each(data: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a of each, the longest first and ``ROWS`` at a time, so what is laid out does not grow with the batch."""
    order = sorted(range(len(data)), key=lambda i: -len(data[i]))
    out = np.empty(len(data), np.uint64)
    for at in range(0, len(order), ROWS):
        some = order[at : at + ROWS]
        out[some] = _side_by_side([data[i] for i in some])
    return out


def _side_by_side(data: list[bytes]) -> np.ndarray:
    """The same of strings from the longest on: one step for each place, over all strings that are that long."""
    sizes = np.array([len(x) for x in data])
    out = np.full(len(data), 0xCBF29CE484222325, np.uint64)
    for at in range(0, int(sizes[0]), BLOCK):
        live = int(np.searchsorted(-sizes, -at))
        part = np.zeros((live, min(BLOCK, int(sizes[0]) - at)), np.uint8)
        for row in range(live):
            piece = np.frombuffer(data[row][at : at + BLOCK], np.uint8)
            part[row, : len(piece)] = piece
        for k in range(part.shape[1]):
            n = int(np.searchsorted(-sizes, -(at + k)))
            out[:n] = (out[:n] ^ part[:n, k]) * np.uint64(0x100000001B3)
    return out


def fnv1a_hex(column: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        hashes = fnv1a_each([(t or "").encode() for t in texts])
        return pd.Series([None if t is None else f"{h:016x}" for t, h in zip(texts, hashes.tolist())])

    return run(column)
