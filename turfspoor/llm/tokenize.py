"""Encoding of a corpus with a public byte-level BPE tokenizer.

The text is cut into pieces by the tokenizer's public pattern. Each distinct piece is merged once
per Python worker: a segment tree over the ranks of adjacent pairs has at its root the leftmost
pair of lowest rank; a merge updates at most three leaves and their paths, so a piece of n bytes
takes O(n log n), also where a text is one long run of letters.

Null and empty texts have the empty list of ids.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_FOLDER = "/opt/tokenizers"
DEFAULT_FILE = "byte_bpe_50k.tiktoken"
#: The pattern of the published byte-level BPE vocabularies of this kind; a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 60
#: Pieces that a worker remembers; beyond it the memory is emptied and filled again.
REMEMBERED = 200_000


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge_ids(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece, by merging the leftmost pair of lowest rank until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1
    while size < n:
        size *= 2
    # tree[size + i] is the rank of the pair that begins at part i, times n, plus i: the minimum is
    # the lowest rank and, among equal ranks, the leftmost
    tree = [NONE] * (2 * size)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    after = list(range(1, n + 1))
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i
    for k in range(size - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            left, right = tree[2 * k], tree[2 * k + 1]
            low = left if left < right else right
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    def pair(i: int) -> int:
        j = after[i]
        if j >= n:
            return NONE
        rank = ranks.get(piece[i : end[j]])
        return NONE if rank is None else rank * n + i

    while tree[1] < NONE:
        i = tree[1] % n
        j = after[i]
        end[i] = end[j]
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        put(j, NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = after[i]
    return ids


class Encoder:
    """Encodes texts with the ranks of one vocabulary file; remembers pieces it has merged."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        self.ranks, self.cut, self.known = load_ranks(path), regex.compile(pattern).findall, {}

    def encode(self, text: str | None) -> list[int]:
        known, out = self.known, []
        if not text:
            return out
        for piece in self.cut(text):
            ids = known.get(piece)
            if ids is None:
                ids = merge_ids(piece.encode("utf-8", "surrogatepass"), self.ranks)
                if len(piece) < 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, file: str = DEFAULT_FILE) -> DataFrame:
    """(key, ids) of every row. Null and empty texts give an empty list, never null.

    Rows come out as often as they are in ``df``; keys may repeat or be null. Other columns are not
    read. ``folder`` is where the cluster keeps the vocabulary files; every worker reads the file
    once. A text is encoded whole, whatever its length; no special token is made or recognised.
    """
    import numpy as np

    path = os.path.join(folder or os.environ.get("TOKENIZER_FOLDER", DEFAULT_FOLDER), file)

    def run(batches):
        encoder = Encoder(path)
        for pdf in batches:
            for start in range(0, len(pdf), 1000):  # bounds what one Arrow batch holds
                part = pdf.iloc[start : start + 1000]
                yield pd.DataFrame({key: part[key], "ids": [np.array(encoder.encode(t), np.int32) for t in part["_text"]]})

    rows = df.select(F.col(key), F.col(text).alias("_text"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"`{key}` {kind}, ids array<int>")
