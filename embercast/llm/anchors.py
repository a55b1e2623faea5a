"""Exact search for windows of text that occur elsewhere, without shuffling every window.

A window is a fixed number of consecutive units (words or bytes) of one
document. Its anchor is the least hash among the shorter runs of units that it
holds, so equal windows have equal anchors. Windows in a row with one anchor
make a segment, and equal windows are always found in segments of one anchor:

1. every chunk of documents reports its anchors, with the number of distinct
   segments of each, and learns which recur, and which are held by more than
   HOT_SEGMENTS segments;
2. it sends each distinct segment of a recurring anchor to the anchor's shard,
   with the earliest place that it has in the chunk; the shard finds the
   windows that stand earlier elsewhere, by the method of its caller. The
   segments of a hot anchor are taken apart first: each window is a segment of
   its own, with the hash of all its units as anchor, so they spread over all
   shards, and equal windows still meet;
3. the chunk removes the units that such windows cover. Later copies of a
   segment inside the chunk are covered as a whole.

Chunks hold about CHUNK_BYTES of text by a hash of id and text, so a passage that
many documents share reaches its shard once from each chunk. The documents are
shuffled once; the three steps read the same exchange.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embercast.llm.arrays import mix, schema_with, tidy

CHUNK_BYTES = 2 << 20
#: Segments, distinct within their chunk, that one anchor may bring to its shard before its windows are dealt one by one.
HOT_SEGMENTS = 4096


@dataclass
class Units:
    """Units of a chunk's documents: row i has units first[i] to first[i + 1]."""

    data: np.ndarray  # bytes of all rows
    first: np.ndarray
    start: np.ndarray | None  # byte spans of the units; None: every byte is a unit
    end: np.ndarray | None
    hashes: np.ndarray  # of the runs of units that start at each unit


@dataclass
class Segments:
    row: np.ndarray
    start: np.ndarray  # unit of the first window
    windows: np.ndarray
    anchor: np.ndarray


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    if len(h) < width:
        return h[:0]
    m, span = h, 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def segments(units: Units, window: int, run: int) -> Segments:
    first, h = units.first, units.hashes
    width = window - run + 1
    m = sliding_min(h, width)
    has = np.flatnonzero(np.diff(first) >= window)
    if not len(has):
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none.astype(np.uint64))
    valid = np.zeros(len(m) + 1, np.int8)
    valid[first[has]] += 1
    stop = first[has + 1] - window + 1
    np.subtract.at(valid, stop, 1)
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (h[:len(m) - 1] == m[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new & valid)
    row = np.searchsorted(first, start, "right") - 1
    following = np.append(start[1:], np.iinfo(np.int64).max)
    return Segments(row, start, np.minimum(following, first[row + 1] - window + 1) - start, mix(m[start]))


def rivals_and_weight(x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each value stands in x, and the sum of its weights."""
    order = np.argsort(x)
    ends = np.append(np.flatnonzero(x[order][1:] != x[order][:-1]), len(x) - 1)
    out = np.empty(len(x), np.int64)
    size = np.diff(ends, prepend=-1)
    out[order] = np.repeat(size, size)
    if not len(x):
        return out, weight
    total = np.empty(len(x), np.int64)
    total[order] = np.repeat(np.add.reduceat(weight[order], ends - size + 1), size)
    return out, total


def grouped(x: np.ndarray) -> list[np.ndarray]:
    """The places of each value in x."""
    order = np.argsort(x, kind="stable")
    return np.split(order, np.flatnonzero(x[order][1:] != x[order][:-1]) + 1) if len(x) else []


def packed(*parts) -> bytes:
    return zstandard.compress(pickle.dumps(parts, pickle.HIGHEST_PROTOCOL), 1)


def unpacked(data: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(data))


class Chunk:
    """One chunk's rows in a fixed order, with their segments."""

    def __init__(self, table: pa.Table, doc_id: str, text: str, units_of: Callable[[list[bytes]], Units], window: int, run: int, shards: int):
        texts, ids = pc.fill_null(table.column(text).cast(pa.large_binary()), b"").to_pylist(), table.column(doc_id).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i], texts[i]) if ids[i] is not None else (True, 0, texts[i]))
        self.table, self.ids, self.texts = table.take(pa.array(order, pa.int64())), [ids[i] for i in order], [texts[i] for i in order]
        # rows without an id take no part: they are left out as if they were empty
        self.units = units_of([t if i is not None else b"" for t, i in zip(self.texts, self.ids, strict=True)])
        self.segments, self.window, self.run, self.shards = segments(self.units, window, run), window, run, shards
        self.anchors, self.which, self.counts = np.unique(self.segments.anchor, return_inverse=True, return_counts=True)
        self.shard = (self.anchors >> np.uint64(32)) % np.uint64(shards)

    def by_shard(self) -> Iterator[tuple[int, np.ndarray]]:
        for s in np.unique(self.shard).tolist():
            yield s, np.flatnonzero(self.shard == s)

    def content(self, i: np.ndarray) -> list[bytes]:
        u, s = self.units, self.segments
        a, b = s.start[i], s.start[i] + s.windows[i] + self.window - 1
        if u.start is not None:
            a, b = u.start[a], u.end[b - 1]
        data = u.data.tobytes()
        return [data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]

    def hashed(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span of units (``run`` long at least), from those of the runs that cover it."""
        out = mix(size.astype(np.uint64))
        for at in range(0, int(size.max(initial=0)), self.run):
            inside = np.flatnonzero(at < size)
            out[inside] = mix(out[inside] * np.uint64(0x9E3779B97F4A7C15) + self.units.hashes[start[inside] + np.minimum(at, size[inside] - self.run)])
        return out

    def kinds(self) -> np.ndarray:
        """For each anchor that several segments have, how many of them differ (by 64-bit hashes)."""
        several = self.counts > 1
        mine = np.flatnonzero(several[self.which])
        s = self.segments
        content = self.hashed(s.start[mine], s.windows[mine] + self.window - 1)
        order = np.lexsort((content, self.which[mine]))
        w, content = self.which[mine][order], content[order]
        new = np.append(True, (w[1:] != w[:-1]) | (content[1:] != content[:-1])) if len(w) else np.zeros(0, bool)
        return np.bincount(w[new], minlength=len(self.anchors))[several]

    def settle(self, answers: dict[int, bytes]) -> None:
        """Keep the segments of recurring anchors, and take those of hot anchors apart."""
        recurring, hot = np.zeros(len(self.anchors), bool), np.zeros(len(self.anchors), bool)
        for s, at in self.by_shard():
            if answers.get(s):
                bits = np.unpackbits(np.frombuffer(answers[s], np.uint8).reshape(-1, -(-len(at) // 8)), axis=1, count=len(at)).astype(bool)
                recurring[at] = bits[0]
                hot[at] = bits[1] if len(bits) > 1 else False
        s = self.segments
        apart, whole = np.flatnonzero(hot[self.which]), np.flatnonzero((recurring & ~hot)[self.which])
        size = s.windows[apart]
        start = np.repeat(s.start[apart], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.segments = Segments(
            np.concatenate([s.row[whole], np.repeat(s.row[apart], size)]), np.concatenate([s.start[whole], start]),
            np.concatenate([s.windows[whole], np.ones(len(start), np.int64)]), np.concatenate([s.anchor[whole], self.hashed(start, np.full(len(start), self.window))]),
        )

    def distinct(self) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of the settled segments: the number of the distinct content of each,
        and for each distinct content its first segment and its bytes."""
        chosen = np.arange(len(self.segments.start))
        texts = self.content(chosen)
        known = {t: k for k, t in enumerate(dict.fromkeys(texts))}
        kind = np.fromiter(map(known.__getitem__, texts), np.int64, len(texts))
        doc, place = self.places(chosen)
        order = np.lexsort((place, doc, kind))
        first = order[np.append(True, np.diff(kind[order]) > 0)] if len(order) else order
        return kind, first, list(known)

    def places(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document id and first unit in the document of segments."""
        row = self.segments.row[i]
        ids = np.array([x if x is not None else 0 for x in self.ids], np.int64)
        return ids[row], self.segments.start[i] - self.units.first[row]


def shard_order(chunk: Chunk, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distinct contents by the shard of their anchor."""
    shard = (chunk.segments.anchor[first] >> np.uint64(32)) % np.uint64(chunk.shards)
    for s in np.unique(shard).tolist():
        yield s, np.flatnonzero(shard == s)


def removed_units(chunk: Chunk, answers: dict[int, bytes], whole_documents: bool) -> np.ndarray:
    """A mark for each unit of a settled chunk that a window with an earlier occurrence covers."""
    seg, n = chunk.segments, int(chunk.units.first[-1])
    mark = np.zeros(n + 1, np.int64)
    kind, first, _ = chunk.distinct()
    chosen = np.arange(len(kind))
    if len(chosen):
        count = seg.windows[first]
        at = np.cumsum(count) - count
        flags = np.zeros(int(count.sum()), bool)
        for s, mine in shard_order(chunk, first):
            size = count[mine]
            place = np.repeat(at[mine] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            flags[place] = np.unpackbits(np.frombuffer(answers[s], np.uint8), count=len(place)).astype(bool)
        size = seg.windows[chosen]
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        (doc, place), (doc_first, place_first) = chunk.places(chosen), chunk.places(first)
        if whole_documents:  # only another document's occurrence counts as earlier
            later = doc != doc_first[kind]
        else:
            later = (doc != doc_first[kind]) | (place != place_first[kind])
        bad = flags[np.repeat(at[kind], size) + inner] | np.repeat(later, size)
        mark[(np.repeat(seg.start[chosen], size) + inner)[bad]] = 1
    covered = np.cumsum(mark)
    covered[chunk.window:] -= covered[:-chunk.window].copy() if n + 1 > chunk.window else 0
    return covered[:n] > 0


def find(df: DataFrame, units_of: Callable[[list[bytes]], Units], window: int, run: int, in_shard: Callable[[list[tuple]], list[np.ndarray]],
         finish: Callable[[Chunk, np.ndarray], dict[str, pa.Array]], added: dict[str, str], whole_documents: bool, doc_id: str, text: str) -> DataFrame:
    """``df`` with the columns that ``finish`` makes of each chunk's removed units.

    ``in_shard`` gets (anchors, windows, ids, starts, contents) of every chunk and returns for each chunk a
    mark for each window in turn: whether an equal window stands earlier.
    """
    spark = df.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    docs = df.withColumn(text, F.col(text).cast("string")).withColumn(doc_id, F.col(doc_id).cast("long"))
    docs = docs.withColumn("_chunk", F.pmod(F.xxhash64(doc_id, text), F.lit(chunks))).repartition(shards, "_chunk")
    made = lambda table: Chunk(table, doc_id, text, units_of, window, run, shards)
    answer = "_chunk long, shard long, bits binary"

    def report(table: pa.Table) -> pa.Table:
        c = made(table)
        kinds = np.ones(len(c.anchors), np.int64)
        kinds[c.counts > 1] = c.kinds()
        # a bit for each anchor that stands there several times, then the number of distinct segments of each of these
        several = lambda at: np.packbits(c.counts[at] > 1).tobytes() + np.minimum(kinds[at][c.counts[at] > 1], 0xFFFF).astype("<u2").tobytes()
        rows = [(s, c.anchors[at].astype("<u4").tobytes(), several(at)) for s, at in c.by_shard()]
        key = table.column("_chunk")[0].as_py()
        return pa.table({"_chunk": pa.array([key] * len(rows), pa.int64()), "shard": pa.array([r[0] for r in rows], pa.int64()), "anchors": pa.array([r[1] for r in rows], pa.binary()), "bits": pa.array([r[2] for r in rows], pa.binary())})

    def gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list[dict]]:
        by: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                by.setdefault(r["shard"], []).append(r)
        return by

    def recur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in gathered(batches).items():
            own = [np.frombuffer(r["anchors"], "<u4") for r in rows]
            several = [np.unpackbits(np.frombuffer(r["bits"], np.uint8, -(-len(a) // 8)), count=len(a)).astype(bool) for r, a in zip(rows, own, strict=True)]
            weight = [np.ones(len(a), np.int64) for a in own]
            for r, a, w, x in zip(rows, own, weight, several, strict=True):
                w[x] = np.frombuffer(r["bits"], "<u2", offset=-(-len(a) // 8))
            often, total = rivals_and_weight(np.concatenate(own), np.concatenate(weight))
            found, hot = (often > 1) | np.concatenate(several), total > HOT_SEGMENTS
            ends = np.cumsum([len(a) for a in own])[:-1]
            bits = [np.packbits(x).tobytes() + (np.packbits(y).tobytes() if y.any() else b"") for x, y in zip(np.split(found, ends), np.split(hot, ends), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r["_chunk"] for r in rows], pa.int64()), pa.array([shard] * len(rows), pa.int64()), pa.array(bits, pa.binary())], names=["_chunk", "shard", "bits"])

    def send(table: pa.Table, known: pa.Table) -> pa.Table:
        out = {"_chunk": [], "shard": [], "bits": [], "data": []}
        if table.num_rows:
            c = made(table)
            answers = {r["shard"]: r["bits"] for r in known.to_pylist()}
            c.settle(answers)
            _, first, contents = c.distinct()
            s, (doc, place) = c.segments, c.places(first)
            parts = {k: at for k, at in shard_order(c, first)}
            for k, bits in (dict.fromkeys(parts, b"") | answers).items():  # windows of hot anchors go to further shards
                at = parts.get(k, np.zeros(0, np.int64))
                f = first[at]
                out["_chunk"].append(table.column("_chunk")[0].as_py())
                out["shard"].append(k)
                out["bits"].append(bits)  # comes back with the shard's answer
                out["data"].append(packed((s.anchor[f] & np.uint64(0xFFFFFFFF)).astype(np.uint32), s.windows[f].astype(np.int32), doc[at], place[at], [contents[i] for i in at.tolist()]))
        kinds = {"_chunk": pa.int64(), "shard": pa.int64(), "bits": pa.binary(), "data": pa.binary()}
        return pa.table({name: pa.array(x, kinds[name]) for name, x in out.items()})

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = tidy(lambda rows: [np.packbits(m).tobytes() for m in in_shard([unpacked(r.pop("data")) for r in rows])])
        for shard, rows in gathered(batches).items():
            found = marked(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["_chunk"] for r in rows], pa.int64()), pa.array([shard] * len(rows), pa.int64()), pa.array([r["bits"] for r in rows], pa.binary()), pa.array(found, pa.binary())],
                names=["_chunk", "shard", "bits", "found"],
            )

    def remove(table: pa.Table, known: pa.Table) -> pa.Table:
        c, rows = made(table), known.to_pylist()
        c.settle({r["shard"]: r["bits"] for r in rows})
        gone = removed_units(c, {r["shard"]: r["found"] for r in rows}, whole_documents)
        columns = finish(c, gone)
        keep = c.table.drop_columns(["_chunk"])
        names = [*keep.schema.names, *(x for x in columns if x not in keep.schema.names)]
        return pa.table([columns[x] if x in columns else keep.column(x) for x in names], names=names)

    result = schema_with(docs.drop("_chunk"), added)
    reports = docs.groupBy("_chunk").applyInArrow(tidy(report), "_chunk long, shard long, anchors binary, bits binary")
    first_answers = reports.repartitionById(shards, F.col("shard").cast("int")).mapInArrow(recur, answer)
    sent = docs.groupBy("_chunk").cogroup(first_answers.groupBy("_chunk")).applyInArrow(tidy(send), answer + ", data binary")
    second = sent.repartitionById(shards, F.col("shard").cast("int")).mapInArrow(match, answer + ", found binary")
    return docs.groupBy("_chunk").cogroup(second.groupBy("_chunk")).applyInArrow(tidy(remove), result)
