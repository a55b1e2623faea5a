"""Hierarchical packing of documents into sequences of several context sizes.

A document's ids are cut into whole windows of the longest context; what is left
over is routed to the tier whose context size is the smallest power of two that
holds it. Tiers are packed from the longest to the shortest: each piece opens a
window of its tier, and the gap behind it is filled from shorter tiers, always
with the longest piece that fits; only if none fits is a piece cut to the gap,
and its rest is routed again. So every window but those made of a pool's last
few tokens is full. The last tokens close with windows of smaller powers of two.
Windows are dealt to step groups of about equal token numbers.

Every task packs its own rows in pools of bounded size, so nothing is shuffled
and no task waits for another.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embercast.llm.arrays import slices, text_or_empty
from embercast.llm.token_files import ALPHABET, tokenizer

CONTEXT, SHORTEST = 2048, 128
POOL_TOKENS, STEP_TOKENS = 1 << 20, 32 * CONTEXT
#: Chunks kept in each of the two generations of the cache of a Python worker.
CACHE_CHUNKS = 1 << 19
#: Marks that are a piece of their own between a letter and the end of a chunk.
MARKS = ".,;:!?"
#: White space as the splitter of byte-level tokenizers sees it.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CROSSING = re.compile(f"[{BLANK}] (?:[{BLANK}]|$)")
STRETCHES = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+$")


def splits_plainly(settings: dict) -> bool:
    """Whether a tokenizer's settings are those of plain byte-level BPE, for which ``ChunkEncoder`` splits texts."""
    splitter, model = settings.get("pre_tokenizer") or {}, settings["model"]
    plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    tied = any(settings.get(x) for x in ("normalizer", "post_processor", "truncation", "padding"))
    return bool(plain and not tied and model["type"] == "BPE" and not any(model.get(x) for x in odd))


class Chunks(dict):
    """Packed ids of chunks that stand behind one space, made when first asked for."""

    def __init__(self, of, old: dict):
        super().__init__()
        self.tokenizer, self.old, self.tokenize = of, old, of.model.tokenize
        self.marks = {m: self.ids(m) for m in MARKS}

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            if chunk.isalpha() and max(chunk) <= "\u024f":  # one run of letters goes straight to the model
                written = "\u0120" + (chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(ALPHABET))
                got = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(written)])
            elif chunk[-1:] in self.marks and chunk[-2:-1].isalpha() and chunk[-2] <= "\u024f":
                got = self[chunk[:-1]] + self.marks[chunk[-1]]
            else:
                got = self.ids(" " + chunk)
        self[chunk] = got
        return got


class ChunkEncoder:
    """The library's ids of whole texts, by chunks that are encoded once.

    A byte-level splitter never matches across the place between a visible
    character and white space, so a text's ids are those of its chunks one
    after another. A text is cut at its spaces; where white space stands on both
    sides of such a cut it is cut by ``STRETCHES`` instead. Texts with a special
    token's name, and tokenizers with other settings, take the whole library.
    Known chunks are kept in two generations, so memory is bounded.
    """

    def __init__(self, path: str, most: int = CACHE_CHUNKS):
        self.tokenizer, self.most = tokenizer(path), most
        settings = json.loads(self.tokenizer.to_str())
        self.plain = splits_plainly(settings)
        self.names = [t["content"] for t in settings.get("added_tokens") or []]
        self.chunks = Chunks(self.tokenizer, {})

    def __call__(self, text: str) -> np.ndarray:
        if not self.plain or any(name in text for name in self.names):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self.chunks) > self.most:
            self.chunks.old = {}
            self.chunks = Chunks(self.tokenizer, self.chunks)
        get, ids = self.chunks.__getitem__, self.chunks.ids
        if CROSSING.search(text):
            parts = [get(s[1:]) if s[0] == " " else ids(s) for s in STRETCHES.findall(text)]
        else:
            first, *rest = text.split(" ")
            parts = [ids(first) if first else b"", *map(get, rest)]
        return np.frombuffer(b"".join(parts), "<u4")


@functools.cache
def chunk_encoder(path: str) -> ChunkEncoder:
    """One for each Python worker, so that chunks stay known from task to task."""
    return ChunkEncoder(path)


class Tiers:
    """Pieces (document, start, ids) by length, and the packing of all of them into full windows."""

    def __init__(self, context: int, shortest: int):
        self.context, self.shortest = context, shortest
        self.by_length, self.lengths = [[] for _ in range(context + 1)], 0  # lengths: a bit for each length that is there

    def put(self, piece: tuple) -> None:
        n = len(piece[2])
        self.by_length[n].append(piece)
        self.lengths |= 1 << n

    def _take(self, n: int) -> tuple:
        piece = self.by_length[n].pop()
        if not self.by_length[n]:
            self.lengths &= ~(1 << n)
        return piece

    def longest(self, most: int) -> tuple | None:
        """Take the longest piece of at most ``most`` ids."""
        fits = self.lengths & ((2 << most) - 1)
        return self._take(fits.bit_length() - 1) if fits else None

    def cut(self, n: int) -> tuple | None:
        """Take the first ``n`` ids of the shortest piece; its rest goes back to the tier that holds it."""
        if not self.lengths:
            return None
        doc, start, ids = self._take((self.lengths & -self.lengths).bit_length() - 1)
        self.put((doc, start + n, ids[n:]))
        return doc, start, ids[:n]

    def windows(self) -> Iterator[list[tuple]]:
        size = self.context
        while size >= self.shortest:
            least = size // 2 if size > self.shortest else 0
            while self.lengths >> (least + 1):  # pieces that were routed to this tier
                window, gap = [self.longest(size)], size
                gap -= len(window[0][2])
                while gap and (piece := self.longest(gap) or self.cut(gap)):
                    window.append(piece)
                    gap -= len(piece[2])
                yield from self.closing(window) if gap else [window]
            size //= 2

    @staticmethod
    def closing(window: list[tuple]) -> Iterator[list[tuple]]:
        """The last ids of a pool in windows of as many ids as the powers of two that add up to them."""
        left = sum(len(p[2]) for p in window)
        while left:
            size = gap = 1 << (left.bit_length() - 1)
            part = []
            while gap:
                doc, start, ids = window[0]
                part.append((doc, start, ids[:gap]))
                if len(ids) > gap:
                    window[0] = (doc, start + gap, ids[gap:])
                else:
                    window.pop(0)
                gap -= len(part[-1][2])
            yield part
            left -= size


def balanced(lengths: list[int], step_tokens: int) -> list[int]:
    """A step group for each window: the longest first, each to the group with the fewest tokens so far."""
    groups = [(0, g) for g in range(max(1, -(-sum(lengths) // step_tokens)))]
    out = [0] * len(lengths)
    for w in sorted(range(len(lengths)), key=lambda w: -lengths[w]):
        tokens, g = groups[0]
        out[w] = g
        heapq.heapreplace(groups, (tokens + lengths[w], g))
    return out


COLUMNS = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long, ids binary"


def pack(
    df: DataFrame, tokenizer_path: str, end_id: int = 1, context: int = CONTEXT, shortest: int = SHORTEST,
    pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Every document's ids and ``end_id``, packed: one row per piece.

    doc_id, start (the document's ids before the piece), length, doc_tokens
    (with the end id), sequence_id, offset (in the sequence, without gaps),
    sequence_tokens, step_group, ids (32-bit little-endian). ``context`` and
    ``shortest`` are powers of two; every sequence has a power of two of ids, at
    most ``context``, so none needs padding; sequences shorter than ``shortest``
    come from a pool's last ids only. Null or empty text has the end id alone. A
    null doc_id stays null; repeated rows are packed each; other columns are not
    returned; an empty table has no pieces. Ids of sequences and groups follow
    from a row's partition and place, so a task that runs twice gives the same.
    """
    if context & (context - 1) or shortest & (shortest - 1) or not 0 < shortest <= context:
        raise ValueError("context and shortest must be powers of two, shortest the smaller")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = chunk_encoder(tokenizer_path), np.array([end_id], np.uint32)
        number = group = TaskContext.get().partitionId() << 32
        whole, tiers, held = [], Tiers(context, shortest), 0

        def flush() -> pa.RecordBatch:
            nonlocal number, group, whole, tiers, held
            windows = [*([p] for p in whole), *tiers.windows()]
            lengths = [sum(len(p[2]) for p in w) for w in windows]
            groups = balanced(lengths, step_tokens)
            pieces = [p for w in windows for p in w]
            n = np.array([len(p[2]) for p in pieces], np.int64)
            of = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
            before = np.cumsum(lengths) - lengths
            out = pa.RecordBatch.from_arrays([
                pa.array([p[0][0] for p in pieces], pa.int64()), pa.array([p[1] for p in pieces], pa.int64()), pa.array(n),
                pa.array([p[0][1] for p in pieces], pa.int64()), pa.array(number + of), pa.array(np.cumsum(n) - n - before[of]),
                pa.array(np.array(lengths, np.int64)[of]), pa.array(group + np.array(groups, np.int64)[of]),
                pa.array([p[2].astype("<u4").tobytes() for p in pieces], pa.binary()),
            ], names=[c.split()[0] for c in COLUMNS.split(", ")])
            number, group = number + len(windows), group + max(groups) + 1
            whole, tiers, held = [], Tiers(context, shortest), 0
            return out

        for batch in slices(batches, "text"):
            for key, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.concatenate([encode(t), end])
                doc = (key, len(ids))
                for start in range(0, len(ids), context):
                    piece = (doc, start, ids[start:start + context])
                    if len(piece[2]) == context:
                        whole.append(piece)
                    else:
                        tiers.put(piece)
                    held += len(piece[2])
                    if held >= pool_tokens:
                        yield flush()
        if held:
            yield flush()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, COLUMNS)
