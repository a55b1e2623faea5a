"""Ranked lexical search without random access (NRA).

Documents are indexed in shards, each a bounded stretch of one task's rows: for
each term the documents that hold it, with its frequency. Of the terms only
those enter that can stand in a query, by a bitmap of fixed size. Corpus
statistics are summed up from the shards, which gives every posting its impact,
the integer that it adds to a score.

For each item a shard's lists are read in step, best impacts first. What a
document has gathered so far is its lower bound; adding the next unread impact
of the lists in which it has not been seen gives its upper bound. Reading goes on
until no document that has not been seen, and none whose bounds are apart, can
reach the k-th best lower bound, ties included; so scores are exact and no
document is looked up out of order. A task carries each item's best k from shard
to shard, and their k-th score is the next shard's first threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embercast.llm.arrays import LOWER, give_back, prefix_hash, slices, span_hash, text_or_empty, utf8, words, written

#: Bytes of terms: digits, ASCII letters, everything beyond ASCII.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
BITMAP = 1 << 22
SHARD_BYTES, QUERY_ROWS, STEP, TASKS = 16 << 20, 1 << 18, 64, 256


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all terms of a text column (only A-Z lower-cased), and the row of each."""
    data, offsets = utf8(column)
    starts, ends, first = words(data, offsets, TERM)
    return span_hash(prefix_hash(LOWER[data]), starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def counted(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, row), in the order of terms and then rows, with the number of each."""
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1]))[:len(keys)])
    return keys[new], rows[new], np.diff(np.append(new, len(keys)))


def query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """place (a number for each row of the items), item_id, term and times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            term, row, times = counted(*terms(batch.column("text")))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("place").take(at), batch.column("item_id").take(at), pa.array(term.astype(np.int64)), pa.array(times)], names=["place", "item_id", "term", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("place"), F.col(item_id).cast("long").alias("item_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, "place long, item_id long, term long, times long")


def bitmap(queries: DataFrame) -> np.ndarray:
    """BITMAP bits, set for each term: of fixed size, whatever the number of terms."""
    bit = F.pmod("term", F.lit(BITMAP)) + 1
    parts = queries.select(F.bitmap_bucket_number(bit).alias("b"), F.bitmap_bit_position(bit).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros(BITMAP // 8, np.uint8)
    for row in parts.collect():  # at most BITMAP / 32768 rows of 4 KB
        at = (row["b"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return np.unpackbits(out, bitorder="little").astype(bool)


def shards(docs: DataFrame, wanted: np.ndarray, doc_id: str, text: str, shard_bytes: int) -> DataFrame:
    """The index: n_docs and n_terms (of documents with a term), ids, lengths, terms, first posting of each, documents and frequencies."""
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may_be = np.unpackbits(bits.value).astype(bool)
        ids, lengths, held, n, size = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, lengths, held, n, size
            key, row, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")  # rows stay in order within a term
            key, row, tf = key[order], row[order], tf[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
            length = np.concatenate(lengths)
            out = pa.RecordBatch.from_pydict({
                "n_docs": [len(length)], "n_terms": [int(length.sum())], "ids": pa.array([[x for part in ids for x in part]], pa.list_(pa.int64())),
                "lengths": [length.astype("<i8").tobytes()], "terms": [key[first].astype("<u8").tobytes()],
                "first": [np.append(first, len(key)).astype("<i8").tobytes()], "docs": [row.astype("<i4").tobytes()], "tf": [tf.astype("<i4").tobytes()],
            })
            ids, lengths, held, n, size = [], [], [], 0, 0
            give_back()
            return out

        for batch in slices(batches, "text"):
            column = batch.column("text")
            key, row = terms(column)
            own = np.bincount(row, minlength=batch.num_rows)
            there = np.flatnonzero(own)
            number = np.cumsum(own > 0) - 1  # documents without a term aren't counted
            known = may_be[(key & np.uint64(BITMAP - 1)).astype(np.int64)]
            key, row, tf = counted(key[known], row[known])
            ids.append(batch.column("doc_id").take(pa.array(there)).to_pylist())
            lengths.append(own[there])
            held.append((key, number[row] + n, tf))
            n, size = n + len(there), size + column.nbytes
            if size >= shard_bytes and n:
                yield flush()
        if n:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, "n_docs long, n_terms long, ids array<long>, lengths binary, terms binary, first binary, docs binary, tf binary")


def frequencies(index: DataFrame) -> DataFrame:
    """term and df: the number of documents with each indexed term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, f in zip(batch.column("terms").to_pylist(), batch.column("first").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, "<i8")), pa.array(np.diff(np.frombuffer(f, "<i8")))], names=["term", "df"])

    return index.select("terms", "first").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of n terms: 100 - 25 + (25 * n * n_docs) div n_terms, in whole numbers."""
    if len(n) and 25 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 75 + 25 * n * n_docs // n_terms


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n: int, k: int, least: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Documents (of n) that can be among the k best, and their exact scores.

    lists: documents and impacts of a list, best first. least: only scores of
    at least this matter. Returns every document whose score ties with the k-th
    best or is above it."""
    lower, seen, at = np.zeros(n, np.int64), np.zeros((len(lists), n), bool), 0
    least = max(least, 1)
    while True:
        ahead = np.zeros(len(lists), np.int64)
        for i, (docs, impact) in enumerate(lists):
            read = docs[at:at + step]
            lower[read] += impact[at:at + step]
            seen[i, read] = True
            if at + step < len(docs):
                ahead[i] = impact[at + step]
        at, step = at + step, 2 * step
        unseen = int(ahead.sum())
        kth = max(least, int(np.partition(lower, n - k)[n - k])) if n >= k else least
        if unseen and unseen >= kth:
            continue  # a document that stands in no read part may still belong to the best
        near = np.flatnonzero((lower > 0) & (lower + unseen >= kth))
        if unseen:
            apart = unseen - ahead @ seen[:, near]
            near, apart = near[lower[near] + apart >= kth], apart[lower[near] + apart >= kth]
            if apart.any():
                continue  # membership or a score isn't settled yet
        return near, lower[near]


def search_shard(shard: dict, queries: list[tuple], vocabulary: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, k: int, best: list[list[tuple]]) -> None:
    """Bring ``best`` (for each query its k best as (-score, no id, id)) up to date with one shard.

    queries: for each the numbers of its terms in ``vocabulary``, and their times."""
    own, first = np.frombuffer(shard["terms"], "<u8"), np.frombuffer(shard["first"], "<i8")
    docs, tf = np.frombuffer(shard["docs"], "<i4"), np.frombuffer(shard["tf"], "<i4").astype(np.int64)
    m = length_norm(np.frombuffer(shard["lengths"], "<i8"), n_docs, n_terms)
    part = 1_000_000_000 * tf // (1000 * tf + 12 * m[docs])
    order = np.lexsort((docs, -part, np.repeat(np.arange(len(own)), np.diff(first))))
    docs, part = docs[order], part[order]
    place = np.searchsorted(own, vocabulary)
    there = (place < len(own)) & (own[np.minimum(place, len(own) - 1)] == vocabulary) if len(own) else np.zeros(len(vocabulary), bool)
    ids = shard["ids"]
    for q, (numbers, times) in enumerate(queries):
        lists, most = [], 0
        for number, t in zip(numbers.tolist(), times.tolist(), strict=True):
            if there[number] and weights[number] > 0:
                a, b = first[place[number]], first[place[number] + 1]
                lists.append((docs[a:b], part[a:b] * (int(weights[number]) * t)))
                most += int(lists[-1][1][0])
        least = -best[q][-1][0] if len(best[q]) >= k else 1
        if lists and most >= least:
            found, scores = nra(lists, len(ids), k, least)
            best[q] = sorted(best[q] + [(-int(s), ids[d] is None, ids[d] or 0) for d, s in zip(found.tolist(), scores.tolist(), strict=True)])[:k]


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES, query_rows: int = QUERY_ROWS) -> DataFrame:
    """item_id, rank (int, from 1), doc_id and score of each item's k best documents with a score above 0.

    Terms are runs of digits, ASCII letters (lower-cased) and characters beyond
    ASCII; they are told apart by 64-bit hashes. Every row of ``docs`` is a
    document and every row of ``items`` an item, repeated ones too: an item_id
    that stands twice is ranked twice. Null text has no term; documents without
    a term count nowhere, items without a term return nothing. Of equal scores
    the smaller doc_id comes first, a null doc_id last. Empty tables give an
    empty result; other columns are ignored. Items are worked off in groups of
    about ``query_rows`` terms, which is the size of what a task is given.
    """
    queries = written(query_terms(items, item_id, item_text), "query-terms")
    index = written(shards(docs, bitmap(queries), doc_id, text, shard_bytes), "lexical-index")
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = total["n"] or 0, total["l"] or 0
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = written(queries.join(frequencies(index), "term").withColumn("weight", weight), "weighted-terms")
    groups = max(1, -(-weighted.count() // query_rows))
    spark, found = docs.sparkSession, None
    for g in range(groups):
        own = weighted.where(F.pmod(F.xxhash64("place"), F.lit(groups)) == g).orderBy("place", "term").toArrow()
        place = own.column("place").to_numpy()
        new = np.flatnonzero(np.append(True, place[1:] != place[:-1])[:len(place)])
        vocabulary, at = np.unique(own.column("term").to_numpy().view(np.uint64), return_index=True)
        numbers = np.searchsorted(vocabulary, own.column("term").to_numpy().view(np.uint64))
        given = spark.sparkContext.broadcast({
            "vocabulary": vocabulary, "weights": own.column("weight").to_numpy()[at], "places": place[new].tolist(), "items": own.column("item_id").take(pa.array(new)).to_pylist(),
            "queries": list(zip(np.split(numbers, new[1:]), np.split(own.column("times").to_numpy(), new[1:]), strict=True)) if len(new) else [],
        })

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            v = given.value
            best, task = [[] for _ in v["queries"]], TaskContext.get().partitionId()
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    search_shard(shard, v["queries"], v["vocabulary"], v["weights"], n_docs, n_terms, k, best)
            rows = [(v["places"][q], v["items"][q], task, None if none else d, -s) for q, b in enumerate(best) for s, none, d in b]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["place", "item_id", "task", "doc_id", "score"])
            give_back()

        part = index.select("ids", "lengths", "terms", "first", "docs", "tf").mapInArrow(run, "place long, item_id long, task long, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    # the best of some tasks first, so that no item's rows of all tasks meet in one place
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("some", F.floor(F.col("task") / TASKS))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("place", "some").orderBy(*order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
