"""Packing, centroid clustering and ranked lexical search against the library and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from embercast.llm import centroids, lexical, packing
from embercast.llm.queries import BYTE_BPE, op11_packing, op12_centroids, op13_ranked_search
from tests.llm.helpers import documents, frame, prose
from tests.llm.test_tokens import PIECES


def test_chunk_encoder_equals_library():
    encode, library, rng = packing.ChunkEncoder(BYTE_BPE, most=60), Tokenizer.from_file(BYTE_BPE), random.Random(11)
    assert encode.plain
    pieces = [*PIECES, "\t", "\xa0", " ", "\r\n", "don't", "x's", " 'll", "12a", "á", "\x1d", "word,", "É.", "ǅ", "ɐ"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_take_the_library():
    import json

    settings = json.loads(Tokenizer.from_file(BYTE_BPE).to_str())
    assert packing.splits_plainly(settings)
    assert not packing.splits_plainly(settings | {"normalizer": {"type": "NFC"}})
    assert not packing.splits_plainly(settings | {"pre_tokenizer": settings["pre_tokenizer"] | {"add_prefix_space": True}})


def assert_packed(pieces, expected, context):
    """expected: a multiset of (doc_id, ids). Every id stands in exactly one piece, sequences are gapless and full."""
    sequences, texts = defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0
        sequences[r["sequence_id"]].append(r)
        texts[r["doc_id"]].append((r["start"], ids.tolist(), r["doc_tokens"]))
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == rows[0]["sequence_tokens"] <= context and at & (at - 1) == 0
        assert len({r["step_group"] for r in rows}) == 1
    own = defaultdict(list)
    for doc, ids in expected:
        own[doc].append(ids)
    assert set(own) == set(texts)
    for doc, lists in own.items():
        if len(lists) == 1:
            assert [x for _, ids, _ in sorted(texts[doc], key=lambda t: t[0]) for x in ids] == lists[0]
            assert {n for _, _, n in texts[doc]} == {len(lists[0])}
        else:  # repeated rows: the same places as often
            at = Counter(s + i for s, ids, _ in texts[doc] for i in range(len(ids)))
            assert at == Counter(i for ids in lists for i in range(len(ids)))


@pytest.mark.parametrize(("context", "shortest", "pool"), [(2048, 128, 1 << 20), (64, 8, 500), (16, 16, 40), (1, 1, 10)])
def test_packing(spark, context, shortest, pool):
    rows, library = documents(), Tokenizer.from_file(BYTE_BPE)
    rows = rows if context > 1 else rows[:20]
    got = packing.pack(frame(spark, rows), BYTE_BPE, 1, context, shortest, pool, step_tokens=4 * context).collect()
    assert_packed(got, [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows], context)
    steps = Counter()
    for r in got:
        steps[r["step_group"]] += r["length"]
    assert max(steps.values()) <= 4 * context + context


def test_packing_long_empty_and_clashing(spark):
    rng, library = random.Random(3), Tokenizer.from_file(BYTE_BPE)
    text = prose(rng, 1000) * 700  # some 5 MB
    docs = spark.createDataFrame([(1, text, 9, b"x"), (2, None, 9, b"x")], "doc_id long, text string, start long, ids binary")
    got = packing.pack(docs, BYTE_BPE).collect()
    assert_packed(got, [(1, library.encode(text, add_special_tokens=False).ids + [1]), (2, [1])], 2048)
    assert sum(r["sequence_tokens"] < 2048 for r in got) < 64
    assert packing.pack(docs.where("false"), BYTE_BPE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, BYTE_BPE, context=100)


def test_tiers_fill_gaps_and_keep_most_pieces_whole():
    rng, tiers = np.random.default_rng(5), packing.Tiers(2048, 128)
    sizes = rng.integers(1, 2048, 3000).tolist()
    for i, n in enumerate(sizes):
        tiers.put(((i, n), 0, np.zeros(n, np.uint32)))
    windows = list(tiers.windows())
    assert sum(len(p[2]) for w in windows for p in w) == sum(sizes)
    assert all((n := sum(len(p[2]) for p in w)) & (n - 1) == 0 and n <= 2048 for w in windows)
    cut = Counter(p[0][0] for w in windows for p in w)
    assert sum(c > 1 for c in cut.values()) < 0.35 * len(sizes)
    assert len({sum(len(p[2]) for p in w) for w in windows}) > 1


def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centre = [list(v) for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centre))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for c in set(of):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            centre[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total, each = sum(d for _, _, d in found), Counter()
    for _, c, d in found:
        each[c] += d
    return sorted(((i, c, d, each[c], total, hashlib.sha256(",".join(map(str, centre[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


def vectors(seed=2, n=120):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(n)]
    rows += [(None, rows[3][1]), rows[5], rows[5], (n, None), (n + 1, [1.0] * 63), (n + 2, [None] * 64), (n + 3, [float("nan")] * 64), (n + 4, [float("-inf")] * 64)]
    rows += [(n + 5, [0.0] * 64), (n + 6, [9e4] + [-9e4] * 63), (n + 7, []), (n + 8, [-1.0] * 64), (n + 9, rows[0][1])]
    return rows


@pytest.mark.parametrize(("n", "k"), [(120, 7), (2, 40), (60, 1)])
def test_centroids(spark, n, k):
    rows = vectors(n=max(n, 6))
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, cluster int").repartition(3)
    got, _ = centroids.cluster(df, k=k, rounds=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows, k, 4)


def test_centroids_empty_and_too_large(spark):
    schema = "vec_id long, embedding array<float>"
    got, centre = centroids.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema))
    assert got.collect() == [] and len(centre) == 0
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], schema))[0].collect()


def test_popcount_products():
    rng = np.random.default_rng(1)
    for most in (1, 3, 300, 1 << 20):
        a, b = rng.integers(-most, most, (50, 64)), rng.integers(-most, most, (9, 64))
        assert (centroids.vectors(centroids.planes(a)) == a).all()
        assert (centroids.products(centroids.planes(a), centroids.planes(b)) == a @ b.T).all()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k):
    split = lambda t: TERM.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    held = [(d, Counter(ts), len(ts)) for d, t in docs if (ts := split(t))]
    n_docs, n_terms, df = len(held), sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if c[t])
            if s:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "shard_bytes", "query_rows"), [(20, 1 << 24, 1 << 18), (3, 2000, 40), (500, 500, 1 << 18)])
def test_ranked_search(spark, k, shard_bytes, query_rows):
    rng = random.Random(8)
    rows = [r[:2] for r in documents()] + [(2000, prose(rng, 30000)), (2001, "The THE the éA Éa a1b2 ÀÉ")]
    items = [(1, "the of and é"), (2, None), (3, "-- !"), (4, rows[0][1]), (4, "the the ing of"), (None, "one ONE"), (6, "absent"), (7, rows[12][1]), (8, prose(rng, 400))]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, score long, term long").repartition(3)
    got = lexical.search(docs, spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, rank int"), k, shard_bytes=shard_bytes, query_rows=query_rows)
    assert got.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(rows, items, k)


def test_ranked_search_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.where("false"), items).collect() == []
    assert lexical.search(docs, items.where("false")).collect() == []
    assert lexical.search(spark.createDataFrame([(1, " .")], docs.schema), items).collect() == []


def test_nra_equals_whole_sums():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, k, least = int(rng.integers(1, 300)), int(rng.integers(1, 30)), int(rng.integers(0, 60))
        lists, whole = [], np.zeros(n, np.int64)
        for _ in range(rng.integers(1, 6)):
            docs = rng.permutation(n)[:rng.integers(1, n + 1)]
            impact = np.sort(rng.integers(1, 20, len(docs)))[::-1]
            lists.append((docs, impact))
            whole[docs] += impact
        found, scores = lexical.nra(lists, n, k, least, step=2)
        assert (whole[found] == scores).all()
        kth = max(least, 1, np.sort(whole)[-k] if n >= k else 1)
        assert set(np.flatnonzero(whole >= kth)) <= set(found.tolist())


def test_registered_queries(spark):
    sf = "/root/testdata/sf0.001"
    pieces = op11_packing(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    library, used = Tokenizer.from_file(BYTE_BPE), Counter()
    for doc, text in docs.items():
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        own = sorted((r for r in pieces if r["doc_id"] == doc), key=lambda r: r["start"])
        for r in own:
            part = ids[used[doc]:used[doc] + r["length"]]
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (used[doc], zlib.crc32(part.tobytes()), len(ids))
            used[doc] += r["length"]
        assert used[doc] == len(ids)
    found = op12_centroids(spark, sf).collect()
    vecs = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, found), key=repr) == brute_clusters(vecs, 40, 5)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(map(tuple, op13_ranked_search(spark, sf).collect()), key=repr) == brute_search(list(docs.items()), items, 20)
