"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until pieces are short, each piece is encoded alone, and
neighbours are joined: the window around the seam grows on both sides until it
reaches places where the splitting pattern must begin a match whatever stands
beyond (white space after a visible character). Matches never cross such a
place and look only forward, so the tokens outside the window are those of the
whole text, and only the window is encoded again. The join is associative, so
any tree over the pieces gives the ids of the whole text.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from embercast.llm.arrays import schema_with, slices, with_columns

#: Between these two characters every scan of the splitting pattern begins a match.
STABLE = re.compile(r"(?<=[A-Za-z0-9À-ÖØ-öø-ÿ.,;:!?])(?=[ \n])")
LEAF = 2048


@functools.cache
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file; loaded once in each Python worker."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def last_stable(text: str, lo: int, hi: int) -> int:
    """The last stable place in (lo, hi), sought in growing windows; lo if there is none."""
    reach = 64
    while True:
        start = max(lo + 1, hi - reach)
        found = [m.start() for m in STABLE.finditer(text, start, hi) if m.start() > lo]
        if found:
            return found[-1]
        if start == lo + 1:
            return lo
        reach *= 4


def first_stable(text: str, lo: int, hi: int) -> int:
    """The first stable place in (lo, hi); hi if there is none."""
    m = STABLE.search(text, lo + 1, hi)
    return m.start() if m and m.start() < hi else hi


def join(enc: tiktoken.Encoding, text: str, lo: int, left: list[int], mid: int, right: list[int], hi: int) -> list[int]:
    """Ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
    a, b = last_stable(text, lo, mid), first_stable(text, mid, hi)
    drop_left = len(enc.encode_ordinary(text[a:mid]))
    drop_right = len(enc.encode_ordinary(text[mid:b]))
    return left[:len(left) - drop_left] + enc.encode_ordinary(text[a:b]) + right[drop_right:]


def encode_text(enc: tiktoken.Encoding, text: str, lo: int = 0, hi: int | None = None, leaf: int = LEAF) -> list[int]:
    hi = len(text) if hi is None else hi
    if hi - lo <= leaf:
        return enc.encode_ordinary(text[lo:hi])
    mid = (lo + hi) // 2
    return join(enc, text, lo, encode_text(enc, text, lo, mid, leaf), mid, encode_text(enc, text, mid, hi, leaf), hi)


def decode_ids(enc: tiktoken.Encoding, ids: list[int], leaf: int = 8 * LEAF) -> bytes:
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    mid = len(ids) // 2
    return decode_ids(enc, ids[:mid], leaf) + decode_ids(enc, ids[mid:], leaf)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with an array<int> column ``out``: the token ids of the whole text.

    Null or empty text gives an empty array. All rows and columns stay; a column
    already called ``out`` is replaced. Repeated rows are encoded alike; an
    empty table stays empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in slices(batches, text):
            ids = [encode_text(enc, t or "") for t in batch.column(text).to_pylist()]
            yield with_columns(batch, **{out: pa.array(ids, pa.list_(pa.int32()))})

    return df.mapInArrow(run, schema_with(df, {out: "array<int>"}))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with a binary column ``out``: the bytes of the ids (null or empty ids: empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [decode_ids(enc, x or []) for x in part.column(ids).to_pylist()]
                yield with_columns(part, **{out: pa.array(data, pa.binary())})

    return df.mapInArrow(run, schema_with(df, {out: "binary"}))
