"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document is the set of its distinct word shingles (64-bit hashes). Documents
with equal sets are one node. Its sketch has COORDINATES numbers: in round i
every shingle is hashed to a bin and a value, a bin keeps the least (round,
value) that it gets, and rounds go on until all bins are filled; from round
COORDINATES on, round i fills bin i - COORDINATES from all shingles, so every
coordinate is filled for certain. Two sketches agree in a coordinate with the
probability of their sets' similarity. Nodes that agree in all coordinates of a
band share a bucket.

Links are confirmed on whole sets, without pairing off buckets. Every node of a
bucket is held against one of them, its pivot, and kept as its difference from
the pivot, the shingles that only one of the two has. Two similar sets whose
differences have nothing in common are both similar to the pivot, so what is
left untested are pairs that share a shingle of their differences. Groups whose
nodes are still in several components are searched for those: a group of bounded
size in one task by counting shared shingles; in a larger one, blocks of the nodes
outside its largest component meet blocks of all nodes, by their differences. Links that are found go through connected
components twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embercast.llm.arrays import LOWER, mix, prefix_hash, schema_with, slices, span_hash, text_or_empty, tidy, utf8, with_columns, words, written
from embercast.llm.components import components

COORDINATES, BAND = 128, 4
#: Bytes of sets beside a pivot in one task, and of differences in a group that is searched in one.
BLOCK_BYTES, GROUP_BYTES = 8 << 20, 4 << 20


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles (lower-cased A-Z)."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    h = span_hash(prefix_hash(data), starts, ends)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    n = max(0, len(h) - k + 1)
    whole = np.full(n, k, np.uint64)
    for j in range(k):
        whole += h[j:j + n] * factors[j]
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(whole[a:b - k + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            out.append(mix((h[a:b] * factors[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """A row of t coordinates for each set that isn't empty (empty: all ones)."""
    out = np.full(len(sets) * t, np.iinfo(np.uint64).max, np.uint64)
    left = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate([*sets, np.zeros(0, np.uint64)])
    for i in range(2 * t):
        if not len(left):
            break
        h = mix(x + np.uint64((i + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        bins = (h & np.uint64(t - 1)).astype(np.int64) if i < t else np.full(len(x), i - t)
        np.minimum.at(out, rows * t + bins, (np.uint64(i) << np.uint64(56)) | (h >> np.uint64(8)))
        full = (out.reshape(-1, t)[left] != np.iinfo(np.uint64).max).all(axis=1)
        if full.any():
            left = left[~full]
            still = np.isin(rows, left)
            rows, x = rows[still], x[still]
    return out.reshape(len(sets), t)


def bands(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band of each sketch."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // BAND, BAND)
    key = np.broadcast_to(mix(np.arange(1, t // BAND + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for j in range(BAND):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.astype(np.int64)


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def profiles(df: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets; null if empty) and bands of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), k)
            keys = [set_key(s) for s in sets]
            found = bands(sketches(sets))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(list(found), pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def with_sets(docs: DataFrame, nodes: DataFrame, roles: DataFrame, k: int) -> DataFrame:
    """Rows of ``roles`` (node, ...) with the node's shingle set as bytes, from a text of the node's smallest doc_id that has this set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), k)
            own = [set_key(s) == key for s, key in zip(sets, batch.column("set_key").to_pylist(), strict=True)]
            found = with_columns(batch.drop_columns(["text", "set_key"]), set=pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()))
            yield found.filter(pa.array(own, pa.bool_()))

    named = roles.join(nodes, "node").select(*(roles[c] for c in roles.columns), "least", "set_key")
    joined = docs.join(named, docs["doc_id"] == named["least"]).select(*roles.columns, "set_key", "text")
    return joined.mapInArrow(run, schema_with(joined.drop("text", "set_key"), {"set": "binary"}))


def close(distance, sizes, percent: int):
    """Whether sets with ``sizes`` elements together, ``distance`` of them in only one, have the similarity."""
    return (100 + percent) * distance <= (100 - percent) * sizes


def differences(percent: int):
    def run(group: pa.Table) -> pa.Table:
        """The nodes of one block beside their pivot: size, difference from it and whether they are linked."""
        nodes, pivot = group.column("node").to_pylist(), group.column("pivot")[0].as_py()
        sets = {n: np.frombuffer(s, "<u8") for n, s in zip(nodes, group.column("set").to_pylist(), strict=True)}  # repeated rows give a node twice
        own = sets.pop(pivot)
        out = [(n, len(s), np.setxor1d(s, own, assume_unique=True)) for n, s in sets.items()]
        return pa.table({
            "pivot": pa.array([pivot] * len(out), pa.int64()), "node": pa.array([n for n, _, _ in out], pa.int64()), "size": pa.array([k for _, k, _ in out], pa.int64()),
            "linked": pa.array([bool(close(len(x), k + len(own), percent)) for _, k, x in out], pa.bool_()), "difference": pa.array([x.astype("<u8").tobytes() for _, _, x in out], pa.binary()),
        })

    return run


def between(sizes: np.ndarray, labels: np.ndarray, parts: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (places of two sets) that join what belongs together of sets given by their differences from one set.

    Differences are first taken from what most of the sets have, which changes
    no distance. Then any two linked sets share a shingle of their differences,
    or are both linked with the set that is closest to the middle."""
    n, row = len(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    shingle, element = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_inverse=True)
    count = np.bincount(element, minlength=len(shingle))
    common = 2 * count > n
    lacking = np.ones((n, int(common.sum())), bool)
    number = np.cumsum(common) - 1
    lacking[row[common[element]], number[element[common[element]]]] = False
    more, which = np.nonzero(lacking)
    row = np.concatenate([row[~common[element]], more])
    element = np.concatenate([element[~common[element]], np.flatnonzero(common)[which]])
    length = np.bincount(row, minlength=n)
    by_row, by_element = np.lexsort((element, row)), np.lexsort((row, element))
    first = np.searchsorted(element[by_element], np.arange(len(shingle) + 1))
    own_first, own, holders = np.searchsorted(row[by_row], np.arange(n + 1)), element[by_row], row[by_element]
    label, found = labels.copy(), []

    def join(i: int) -> None:
        lists = [holders[first[e]:first[e + 1]] for e in own[own_first[i]:own_first[i + 1]].tolist()]
        shared = np.bincount(np.concatenate(lists), minlength=n) if lists else np.zeros(n, np.int64)
        near = np.flatnonzero(close(length + length[i] - 2 * shared, sizes + sizes[i], percent) & (label != label[i]))
        _, at = np.unique(label[near], return_index=True)
        for j in near[at].tolist():
            found.append((i, j))
            label[label == label[j]] = label[i]

    join(int(np.argmin((100 + percent) * length - (100 - percent) * sizes)))
    names, many = np.unique(label, return_counts=True)
    for i in np.flatnonzero(label != names[many.argmax()]).tolist():
        join(i)
    return found


def in_group(percent: int):
    def run(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_pylist()
        parts = [np.frombuffer(x, "<u8") for x in group.column("difference").to_pylist()]
        found = between(group.column("size").to_numpy(), group.column("label").to_numpy(), parts, percent)
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[j] for _, j in found], pa.int64())})

    return run


def remaining_links(rows: DataFrame, percent: int, group_bytes: int) -> DataFrame:
    """Links (a, b) within groups of rows (grp, node, label, size, difference) whose labels differ.

    Differences are from any set that a group shares. A group of bounded size is one cell. In a larger one only
    nodes outside the most frequent label can have links that matter: blocks of them meet blocks of all nodes."""
    counts = rows.groupBy("grp", "label").agg(F.count("*").alias("n"), F.sum(F.length("difference") + 64).alias("bytes"))
    groups = counts.groupBy("grp").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main"), F.max(F.struct("n", "label", "bytes")).alias("most"), F.sum("bytes").alias("bytes"))
    blocks = lambda x: F.ceil(x / group_bytes).cast("int")
    many, out = blocks(F.col("bytes")), blocks(F.col("bytes") - F.col("most.bytes"))
    groups = written(groups.where("labels > 1").select("grp", "main", many.alias("many"), F.when(many > 1, out).otherwise(1).alias("out")), "open-groups")
    rows = rows.join(groups, "grp")
    block = lambda n: F.pmod(F.xxhash64("node", "grp"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["grp", "node", "label", "size", "difference"]
    members = rows.select(*columns, block("many").alias("j"), each("out").alias("i"))
    outsiders = rows.where("many > 1 AND label <> main").select(*columns, block("out").alias("i"), each("many").alias("j"))
    return members.unionByName(outsiders).groupBy("grp", "i", "j").applyInArrow(tidy(in_group(percent)), "a long, b long")


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents are linked when 100 * shared shingles >= percent * shingles in
    either; component_id is the smallest doc_id that links reach, and kept says
    that it is the row's own. A text with fewer than k words has one shingle,
    the whole sequence; without words, or null, it is linked with nothing. A
    null doc_id has no component and is kept. Rows of equal doc_id are given
    the component of their own text. An empty table stays empty; columns other
    than doc_id and text are ignored. A pair at the threshold is missed when no band agrees: below 1e-7 at a similarity of 0.8.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).where("doc_id IS NOT NULL")
    rows = written(profiles(df, k, doc_id, text), "profiles")
    with_set = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    # a node is a set, not a doc_id: texts of one doc_id can have several sets
    nodes = with_set.groupBy("set_key").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("size")).withColumn("node", F.monotonically_increasing_id())
    nodes = written(nodes, "nodes")
    node_bands = with_set.join(nodes, "set_key").where("doc_id = least").groupBy("node").agg(F.first("bands").alias("bands"))
    node_bands = written(node_bands, "node-bands")
    placed = node_bands.select("node", F.explode("bands").alias("key"))
    buckets = placed.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    hits = written(placed.join(buckets, "key"), "bucket-members")

    pairs = hits.where("node <> pivot").select("node", "pivot").distinct()
    sizes = pairs.join(nodes, "node").groupBy("pivot").agg(F.ceil(F.sum("size") * 8 / BLOCK_BYTES).cast("int").alias("blocks"))
    own = sizes.select(F.col("pivot").alias("node"), F.struct("pivot", "blocks").alias("role"), F.lit(True).alias("itself"))
    others = pairs.join(sizes, "pivot").select("node", F.struct("pivot", "blocks").alias("role"), F.lit(False).alias("itself"))
    roles = own.unionByName(others).groupBy("node").agg(F.collect_list(F.struct("role", "itself")).alias("roles"))  # at most one of each band, and its own
    held = with_sets(docs, nodes, roles, k).select("node", "set", F.explode("roles").alias("r"))
    all_blocks = F.sequence(F.lit(0), F.col("r.role.blocks") - 1)
    one_block = F.array(F.pmod(F.xxhash64("node"), F.col("r.role.blocks")).cast("int"))
    held = held.select("node", "set", F.col("r.role.pivot").alias("pivot"), F.explode(F.when(F.col("r.itself"), all_blocks).otherwise(one_block)).alias("block"))
    beside = held.groupBy("pivot", "block").applyInArrow(tidy(differences(percent)), "pivot long, node long, size long, linked boolean, difference binary")
    beside = written(beside, "differences")
    links = beside.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    labels = components(links, "a", "b")
    label = F.coalesce("component", "node").alias("label")
    rest = beside.join(labels, "node", "left").select(F.col("pivot").alias("grp"), "node", label, "size", "difference")
    links = written(links.unionByName(remaining_links(rest, percent, group_bytes)), "all-links")
    labels = components(links, "a", "b")
    named = labels.join(nodes, "node").select("node", "component", "least")
    reached = named.groupBy("component").agg(F.min("least").alias("reached"))
    out = rows.join(nodes, "set_key", "left").join(labels.join(reached, "component"), "node", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("reached", "least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
