"""Token counts that follow edits.

A document is cut at stable places (see ``bpe``) into segments of about
``SEGMENT`` characters, whose token counts are the leaves of a binary sum tree.
An edit re-encodes the segments that it touches and, while a seam is no longer
a stable place in the new text, their neighbours; then the sums on the way to
the root change. The count of the whole document is never taken again.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from embercast.llm.arrays import schema_with, slices, with_columns
from embercast.llm.bpe import STABLE, encode_text, encoding, first_stable

SEGMENT = 512
TREE = "array<struct<chars:int,tokens:int>>"
EDITS = "array<struct<start:int,end:int,replacement:string>>"


class CountTree:
    """Segments of one text with a binary sum tree over their token counts."""

    def __init__(self, pieces: list[str], counts: list[int]):
        self.pieces, self.reencoded = list(pieces), 0
        self.size = 1 << max(0, len(pieces) - 1).bit_length()
        self.sums = [0] * self.size + counts + [0] * (self.size - len(counts))
        for i in range(self.size - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    def put(self, leaf: int, text: str, tokens: int) -> None:
        """A new segment text and count; the sums on the way to the root follow."""
        self.pieces[leaf] = text
        i = self.size + leaf
        change = tokens - self.sums[i]
        while i and change:
            self.sums[i] += change
            i //= 2


def cut(text: str, segment: int = SEGMENT) -> list[str]:
    """Pieces of about ``segment`` characters that end at stable places (one piece if there are none)."""
    out, at = [], 0
    while len(text) - at > segment:
        to = first_stable(text, at + segment - 1, len(text))
        out.append(text[at:to])
        at = to
    return [*out, text[at:]] if at < len(text) or not out else out


def count(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", tree: str = "segments", total: str = "n_tokens") -> DataFrame:
    """``df`` with the leaves of each document's count tree and the token count.

    Null or empty text has one empty segment and 0 tokens. Rows and other
    columns stay; columns of the two names are replaced.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in slices(batches, text):
            trees = []
            for t in batch.column(text).to_pylist():
                trees.append([(len(p), len(encode_text(enc, p))) for p in cut(t or "")])
            kind = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))
            leaves = [[{"chars": c, "tokens": n} for c, n in x] for x in trees]
            yield with_columns(batch, **{tree: pa.array(leaves, kind), total: pa.array([sum(n for _, n in x) for x in trees], pa.int64())})

    return df.mapInArrow(run, schema_with(df, {tree: TREE, total: "bigint"}))


def edit(enc, tree: CountTree, edits: list[tuple[int, int, str]]) -> None:
    """Change ``tree`` by edits (start, end, replacement) in positions of its text, which do not overlap."""
    starts, at = [], 0
    for p in tree.pieces:
        starts.append(at)
        at += len(p)
    pieces, touched = list(tree.pieces), set()
    for s, e, new in sorted(edits, reverse=True):  # from the end, so that positions before stay as they are
        first = max(0, bisect_right(starts, s) - 1)
        last = max(first, bisect_right(starts, max(s, e - 1)) - 1)
        for i in range(first, last + 1):
            a, b = max(0, s - starts[i]), max(0, e - starts[i])
            pieces[i] = pieces[i][:a] + (new if i == first else "") + pieces[i][b:]
            touched.add(i)
    done = -1
    for i in sorted(touched):
        if i <= done:
            continue
        lo = hi = i
        text, grown = pieces[i], True
        while grown:  # boundary context: neighbours join until both seams are stable in the new text
            grown = False
            if lo - 1 > done and not (text and pieces[lo - 1] and STABLE.match(pieces[lo - 1][-1] + text[0], 1)):
                lo -= 1
                text, grown = pieces[lo] + text, True
            if hi + 1 < len(pieces) and (hi + 1 in touched or not (text and pieces[hi + 1] and STABLE.match(text[-1] + pieces[hi + 1][0], 1))):
                hi += 1
                text, grown = text + pieces[hi], True
        for j in range(lo, hi + 1):
            tree.put(j, text if j == lo else "", len(encode_text(enc, text)) if j == lo else 0)
        tree.reencoded += len(text)
        done = hi


def recount(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", edits: str = "edits", tree: str = "segments", total: str = "n_tokens") -> DataFrame:
    """Apply each row's edits to its text, its count tree and its token count.

    ``edits`` holds structs (start, end, replacement) in characters of the text
    before any edit; they must not overlap (an insertion has start = end).
    Null edits or an empty list change nothing; a null replacement is empty.
    The columns of the text, the tree and the total are replaced, and
    ``reencoded_chars`` is added: characters that were encoded again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in slices(batches, text):
            texts, trees, totals, again = [], [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in (text, tree, edits)), strict=True)
            for t, leaves, todo in rows:
                pieces, at = [], 0
                for x in leaves:
                    pieces.append((t or "")[at:at + x["chars"]])
                    at += x["chars"]
                own = CountTree(pieces, [x["tokens"] for x in leaves])
                if todo:
                    edit(enc, own, [(x["start"], x["end"], x["replacement"] or "") for x in todo])
                texts.append("".join(own.pieces) if todo else t)
                trees.append([{"chars": len(p), "tokens": own.sums[own.size + i]} for i, p in enumerate(own.pieces)])
                totals.append(own.total)
                again.append(own.reencoded)
            kind = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))
            yield with_columns(batch, **{text: pa.array(texts, pa.string()), tree: pa.array(trees, kind), total: pa.array(totals, pa.int64()), "reencoded_chars": pa.array(again, pa.int64())})

    return df.mapInArrow(run, schema_with(df, {text: "string", tree: TREE, total: "bigint", "reencoded_chars": "bigint"}))


#: What the production query replaces: mail addresses, keys of 20 and more capitals and digits, long numbers.
PRIVATE = re.compile(r"[\w.+-]{1,64}@[\w-]{1,63}\.[\w.]{2,63}|\b(?=[A-Z0-9]*\d)[A-Z0-9]{20,}\b|\+?\d[\d() .-]{7,}\d")


def private_edits(df: DataFrame, text: str = "text", edits: str = "edits", pattern: str = PRIVATE.pattern, replacement: str = "[removed]") -> DataFrame:
    """``df`` with the edits that put ``replacement`` for each match of ``pattern`` (null text: none)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).finditer
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())]))
        for batch in slices(batches, text):
            found = [[{"start": m.start(), "end": m.end(), "replacement": replacement} for m in find(t or "")] for t in batch.column(text).to_pylist()]
            yield with_columns(batch, **{edits: pa.array(found, kind)})

    return df.mapInArrow(run, schema_with(df, {edits: EDITS}))
