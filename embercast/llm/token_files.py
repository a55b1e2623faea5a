"""Token-id files: fixed-width bit packing with block offsets.

One file holds whole documents in order::

    magic "EMBTOK01" | bits, block_ids (uint32) | n_docs, n_ids, n_blocks (uint64)
    doc ids (int64) | doc id present (uint8) | first id of each document, then n_ids (uint64)
    byte offset of each block, then the end (uint64) | blocks

All numbers are little-endian. A block packs ``block_ids`` ids (the last one
fewer) in ``bits`` bits each, the smallest width that holds the vocabulary, and
fills whole 64-bit words, so a reader finds any id by its block's offset and
unpacks with numpy. Files are written under a temporary name and then moved,
so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embercast.llm.arrays import slices, text_or_empty, written

MAGIC = b"EMBTOK01"
BLOCK_IDS = 4096
FILE_IDS = 4 << 20
#: Words kept in each of the two generations of the word cache of a Python worker.
CACHE_WORDS = 1 << 19


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first; zeros fill the last 64-bit words."""
    rows = -(-len(ids) // 64)
    table = np.zeros((rows, 64), np.uint64)
    table.reshape(-1)[:len(ids)] = ids
    out = np.zeros((rows, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= table[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= table[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.reshape(-1)[:n].astype(np.uint32)


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks = [pack(flat[i:i + block_ids], bits) for i in range(0, len(flat), block_ids)]
    starts = np.cumsum([0, *map(len, ids)], dtype=np.uint64)
    head = MAGIC + np.array([bits, block_ids], "<u4").tobytes() + np.array([len(ids), len(flat), len(blocks)], "<u8").tobytes()
    index = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is not None for x in doc_ids], np.uint8).tobytes() + starts.astype("<u8").tobytes()
    first = len(head) + len(index) + 8 * (len(blocks) + 1)
    offsets = np.cumsum([first, *map(len, blocks)], dtype=np.uint64).astype("<u8").tobytes()
    return b"".join([head, index, offsets, *blocks])


class TokenFile:
    """Random access to one file, given a function (offset, length) -> bytes."""

    def __init__(self, read):
        self.read = read
        head = read(0, 40)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block_ids = map(int, np.frombuffer(head, "<u4", 2, 8))
        self.n_docs, self.n_ids, self.n_blocks = map(int, np.frombuffer(head, "<u8", 3, 16))
        index = read(40, 17 * self.n_docs + 8 + 8 * (self.n_blocks + 1))
        self.doc_ids = np.frombuffer(index, "<i8", self.n_docs)
        self.present = np.frombuffer(index, np.uint8, self.n_docs, 8 * self.n_docs).astype(bool)
        self.starts = np.frombuffer(index, "<u8", self.n_docs + 1, 9 * self.n_docs).astype(np.int64)
        self.offsets = np.frombuffer(index, "<u8", self.n_blocks + 1, 17 * self.n_docs + 8).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end (exclusive) of the file; reads only their blocks."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block_ids, (end - 1) // self.block_ids
        data = self.read(int(self.offsets[a]), int(self.offsets[b + 1] - self.offsets[a]))
        out = []
        for k in range(a, b + 1):
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            at = int(self.offsets[k] - self.offsets[a])
            out.append(unpack(data[at:at + int(self.offsets[k + 1] - self.offsets[k])], n, self.bits))
        return np.concatenate(out)[start - a * self.block_ids:end - a * self.block_ids]


def store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder's URI, and the path in it."""
    if re.match(r"\w+:/", folder):
        return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    return pyarrow.fs.LocalFileSystem(), os.path.abspath(folder)


def open_file(fs: pyarrow.fs.FileSystem, path: str) -> TokenFile:
    f = fs.open_input_file(path)

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    return TokenFile(read)


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Marks that, after a letter at a word's end, are always a piece of their own.
TAILS = b".,;:!?"
#: Byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


class Words(dict):
    """Packed ids of words, made when first asked for.

    The tokenizer's normaliser lower-cases, its splitter puts a mark after a
    letter apart and leaves a run of letters whole, written byte by byte. So a
    word of letters up to U+024F (composed, with or without a last mark) goes
    straight to the library's BPE model; any other word takes the whole
    library.
    """

    def __init__(self, of, old: dict):
        super().__init__()
        self.tokenizer, self.old, self.direct = of, old, False
        self.tokenize = of.model.tokenize
        kinds = repr(of.normalizer) + repr(of.pre_tokenizer)
        self.direct = all(x in kinds for x in ("NFC", "Lowercase", "ByteLevel", r"[\p{L}]+"))

    def __missing__(self, word: bytes) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.made(word)
        self[word] = got
        return got

    def made(self, word: bytes) -> bytes:
        s = word.decode()
        if self.direct:
            if s.isalpha() and max(s) <= "\u024f" and unicodedata.is_normalized("NFC", s):
                lower = s.lower()
                if lower.isalpha():
                    chars = lower if lower.isascii() else lower.encode().decode("latin-1").translate(ALPHABET)
                    return b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(chars)])
            elif word[-1] in TAILS and len(s) > 1 and s[-2].lower().isalpha() and s[-2] <= "\u024f":
                return self[word[:-1]] + self[word[-1:]]
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


class WordEncoder:
    """Ids of whole texts, by a tokenizer that drops white space between words.

    Such a tokenizer never merges across ASCII white space, so a text's ids are
    those of its words one after another. Known words are kept in two
    generations; when the young one is full the old one is forgotten, so memory
    is bounded and frequent words stay.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        self.tokenizer, self.most = tokenizer(path), most
        self.words = Words(self.tokenizer, {})

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.words) > self.most:
            self.words.old = {}
            self.words = Words(self.tokenizer, self.words)
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, t.split())), "<u4") for t in texts]


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, so that words stay known from task to task."""
    return WordEncoder(path)


def write(df: DataFrame, folder: str, tokenizer_path: str, end_id: int, vocabulary: int, doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every text, append ``end_id``, and write files in ascending ``doc_id`` order.

    Returns the manifest, one row per file: file, part, number, n_docs, n_ids,
    start (ids in all files before it). Null or empty text has the end id alone;
    a null doc_id comes first; rows of equal doc_id stand in the order of their
    texts' hashes; other columns are not stored. An empty table has no files.
    """
    bits = max(1, (max(vocabulary - 1, end_id)).bit_length())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    docs = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        encode, end = word_encoder(tokenizer_path), np.array([end_id], np.uint32)
        part, number, keys, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, keys, ids, held
            name = f"tokens-{part:06d}-{number:06d}.bin"
            temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as f:
                f.write(file_bytes(keys, ids, bits, block_ids))
            fs.move(temporary, f"{base}/{name}")
            row = {"file": [name], "part": [part], "number": [number], "n_docs": [len(keys)], "n_ids": [held]}
            number, keys, ids, held = number + 1, [], [], 0
            return pa.RecordBatch.from_pydict(row)

        fs.create_dir(base, recursive=True)
        for batch in slices(batches, "text"):
            for key, x in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").cast(pa.large_binary()).to_pylist()), strict=True):
                keys.append(key)
                ids += [x, end]
                held += len(x) + 1
                if held >= file_ids:
                    ids = [np.concatenate(ids[k:k + 2]) for k in range(0, len(ids), 2)]
                    yield flush()
        if keys:
            ids = [np.concatenate(ids[k:k + 2]) for k in range(0, len(ids), 2)]
            yield flush()

    files = written(docs.mapInArrow(run, "file string, part long, number long, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row per file, not per document
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(spark: SparkSession, manifest: DataFrame, folder: str, block: int = 1 << 20) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start (ids before it in all files), n_tokens, ids."""
    return _scan(manifest, folder, "ids array<int>", lambda x: pa.array(x, pa.list_(pa.int32())), block)


def digests(spark: SparkSession, manifest: DataFrame, folder: str, block: int = 1 << 20) -> DataFrame:
    """As ``read``, with the crc32 of each document's ids as 32-bit integers in place of the ids."""
    return _scan(manifest, folder, "ids_crc32 long", lambda x: pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in x], pa.int64()), block)


def _scan(manifest: DataFrame, folder: str, column: str, made, block: int) -> DataFrame:
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        for batch in batches:
            for file, start in zip(*(batch.column(c).to_pylist() for c in ("file", "start")), strict=True):
                f = open_file(fs, f"{base}/{file}")
                at = 0
                while at < f.n_docs:
                    to = max(at + 1, int(np.searchsorted(f.starts, f.starts[at] + block, "right")) - 1)
                    ids = f.ids(int(f.starts[at]), int(f.starts[to]))
                    own = f.starts[at:to + 1] - f.starts[at]
                    keys = pc.if_else(pa.array(f.present[at:to]), pa.array(f.doc_ids[at:to]), pa.scalar(None, pa.int64()))
                    rows = [ids[a:b] for a, b in zip(own[:-1], own[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([keys, pa.array(start + f.starts[at:to]), pa.array(np.diff(own)), made(rows)], names=["doc_id", "start", "n_tokens", name])
                    at = to

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "start").repartition(parts, "file").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")
