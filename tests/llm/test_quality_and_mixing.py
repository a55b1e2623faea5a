"""Line rules, mixing, the byte network and exact search against brute force, and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from embercast.llm import mixing, quality_model, quality_rules, topk
from embercast.llm.arrays import utf8
from embercast.llm.queries import op3_line_rules, op4_poisson_mix, op8_quality_net, op9_top_k
from tests.llm.helpers import WORD, documents, frame, prose

SF = "/root/testdata/sf0.001"


def base_rules(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    count, covered = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if count[tuple(words[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_rules_on_documents(spark):
    rng = random.Random(1)
    rows = documents() + [(4000, "a b c d " * 40, "en", "src0", 1), (4001, "\n".join(["one two three. | #", ""] * 30), "en", "src0", 1)]
    rows += [(4100 + i, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 90))), "en", "s", 1) for i in range(40)]
    df = frame(spark, [(*r, "old") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    got = quality_rules.apply_rules(df)
    assert len(set(got.columns)) == len(got.columns)
    rules = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    for r in got.collect():
        assert tuple(r[c] for c in rules) == base_rules(r["text"]), r["text"]
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.apply_rules(frame(spark, [])).count() == 0


def test_line_rules(spark):
    rng = random.Random(8)
    clean = "\n".join(prose(rng, 30) + "." for _ in range(4))
    nav = "\n".join(" | ".join(prose(rng, 2).replace(".", "") for _ in range(20)) for _ in range(4))
    symbols = " ".join(w + "%%%" for w in prose(rng, 100).split())
    shouting = " ".join(w + "!!" for w in prose(rng, 100).upper().split())
    licence = clean + "\nAll rights reserved.\nAccept all cookies"
    rows = [(0, clean, True), (1, nav, False), (2, symbols, False), (3, shouting, False), (4, licence, True), (5, clean + "\n" + nav + nav, False)]
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert [got[i]["kept"] for i, _, _ in rows] == [k for _, _, k in rows]
    assert got[0]["cleaned_text"] == clean == got[4]["cleaned_text"]
    assert got[5]["cleaned_text"].startswith(clean) and "|" not in got[5]["cleaned_text"]


def test_line_rules_run_without_python(spark):
    plan = op3_line_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def uniform(seed, doc):
    return int(hashlib.md5(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:13], 16) / 2 ** 52


def quantile(u, rate):
    n, total = 0, math.exp(-rate)
    while total <= u:
        n += 1
        total += math.exp(-rate + n * math.log(rate) - math.lgamma(n + 1))
    return n


def test_mix_on_documents(spark):
    rows, weights = documents(n=300), {"src0": 3.0, "src1": 1.0, "src2": 0.0, "absent": 5.0}
    df = frame(spark, [(*r, 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, copy int")
    chars = Counter()
    for r in rows:
        chars[r[3]] += len(r[1] or "")
    want = Counter()
    for r in rows:
        if r[3] in ("src0", "src1"):
            rate = weights[r[3]] / 4 * 50_000 / chars[r[3]]
            n = quantile(uniform(5, r[0]), rate)
        else:
            n = 0 if r[3] == "src2" else 2
        for c in range(n):
            want[(*r, c + 1)] += 1
    got = mixing.mix(df, weights, 5, expected_chars=50_000, unlisted=2)
    assert got.columns == df.columns
    assert Counter(map(tuple, got.collect())) == want
    assert [r["doc_id"] for r in got.collect()] == [r["doc_id"] for r in mixing.mix(df.repartition(7), weights, 5, 50_000, 2).collect()]
    assert mixing.mix(frame(spark, []), weights, 5).count() == 0
    assert mixing.mix(df, {}, 5).count() == len(rows)


@pytest.mark.parametrize("rate", [1e-6, 0.14, 1.0, 7.3, 400.0])
def test_poisson_mean(rate):
    steps = mixing.poisson_steps(rate)
    u = (np.arange(20_000) + 0.5) / 20_000
    counts = np.searchsorted(steps, u, "right")
    assert abs(counts.mean() - rate) < 0.01 * rate + 2e-4 and abs(steps[-1] - 1) < 1e-9


def test_mix_reaches_the_weights(spark):
    df = spark.range(20_000).selectExpr("id doc_id", "repeat('x', cast(10 + id % 50 as int)) text", "if(id % 10 < 7, 'big', 'small') source")
    mixed = mixing.mix(df, {"big": 1.0, "small": 1.0}, 3).selectExpr("source", "length(text) AS n").groupBy("source").sum("n")
    got = dict(map(tuple, mixed.collect()))
    assert abs(got["big"] - got["small"]) < 0.05 * (got["big"] + got["small"])
    plan = mixing.mix(df, {"big": 1.0, "small": 1.0}, 3)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Join", plan)


def test_chunks_cover_every_byte():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 511, 512, 513, 768, 769, 5000):
        data = rng.integers(1, 255, n, np.uint8)
        x, rows = quality_model.chunks(np.concatenate([data, data[:7]]), np.array([0, n, n + min(n, 7)]))
        own = x[rows == 0]
        assert len(own) >= 1 and own[:, :quality_model.HOP].reshape(-1)[:n].tolist() == data[:len(own) * quality_model.HOP].tolist()
        end = (len(own) - 1) * quality_model.HOP
        assert own[-1][:max(0, n - end)].tolist() == data[end:].tolist() and end + quality_model.CHUNK >= n


def test_gradient_learns_a_pattern():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdefgh ")) for _ in range(700)) for _ in range(600)]
    at = rng.integers(0, 690, len(texts))  # any alignment
    texts = [t if i % 2 else t[:at[i]] + "QZ!" + t[at[i]:] for i, t in enumerate(texts)]
    x, rows = quality_model.chunks(*utf8(pa.array(texts)))
    labels = np.arange(600) % 2
    net = quality_model.fit(x[rows < 450], rows[rows < 450], labels[:450], epochs=15)
    s = quality_model.scores(net, *utf8(pa.array(texts[450:])))
    assert ((s >= 0.5) == labels[450:]).mean() > 0.9


def test_all_chunks_are_learned_from():
    for n, epochs, most in [(1, 12, 8), (5, 12, 8), (8, 3, 8), (97, 12, 8), (1000, 12, 8), (1000, 4, 300)]:
        order = np.random.default_rng(n).permutation(n)
        seen = [quality_model.drawn(n, e, epochs, most, order) for e in range(epochs)]
        assert set(np.concatenate(seen).tolist()) == set(range(n)) and {len(s) for s in seen} == {min(n, max(most, -(-n // epochs)))}


def test_scores_of_awkward_texts(spark):
    rows = documents()
    net = quality_model.train(frame(spark, []), spark.createDataFrame([], "doc_id long, quality int"))
    got = quality_model.score(frame(spark, [(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int"), net)
    by = {}
    for r in got.collect():
        assert 0 <= r["score"] <= 1 and abs(by.setdefault(r["text"] or "", r["score"]) - r["score"]) < 1e-6
    assert got.count() == len(rows) and quality_model.score(frame(spark, []), net).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op8_quality_net(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95


def test_labels_of_held_out_rows_change_nothing(spark):
    from embercast.llm.queries import held_out

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    turned = labels.withColumn("quality", (1 - labels["quality"])).where(held_out()).unionByName(labels.where(~held_out()))
    a, b = (quality_model.train(docs, x.where(~held_out()), rows_at_most=40) for x in (labels, turned))
    assert all((p == q).all() for p, q in zip(a.parts(), b.parts()))


def exact_top(rows, k, step, scale):
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(rows):
        if i % step == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(rows) if m != n and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [(1024, 256, 8), (16, 3, 2)])
def test_top_k_on_vectors(spark, monkeypatch, block):
    for name, value in zip(("BLOCK", "QUERY_BLOCK", "GROUP_BLOCKS"), block):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(24)]) for i in range(150)]
    rows += [(150, rows[0][1]), (151, rows[0][1]), (0, rows[0][1]), (200, None), (250, []), (300, [float("nan")] * 24), (350, [None] * 24), (None, rows[3][1]), (400, [1.0, 2.0]), (450, [1.0, -2.0]), (500, [1e9] * 24)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = sorted(map(tuple, topk.top_k(df, k=5, step=50, scale=256.0).collect()))
    assert got == exact_top(rows, 5, 50, 256.0)
    assert topk.top_k(df.limit(0)).count() == 0


def test_bounds_leave_most_exact_products_out(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.floor(256 * np.cumsum(rng.normal(0, 1, (1000, 64)), axis=1))
    seen = []
    exact = topk.exact
    monkeypatch.setattr(topk, "exact", lambda a, b: (seen.append(len(a)), exact(a, b))[1])
    best = [[] for _ in range(20)]
    topk.best_of_block(x[:20], [topk.statistics(x[:20], s) for s in topk.LEVELS], x, np.arange(1000), np.arange(20), 5, best)
    for i in range(20):
        want = sorted((-int(x[i] @ x[j]), j) for j in range(1000) if j != i)[:5]
        assert best[i] == want
    assert sum(seen) < 0.2 * 20 * 1000


def test_queries_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    text = {r["doc_id"]: r["text"] for r in docs}
    for r in op3_line_rules(spark, SF).collect():
        assert tuple(r)[1:7] == base_rules(text[r["doc_id"]])
    vectors = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, op9_top_k(spark, SF).collect())) == exact_top(vectors, 5, 50, 256.0)
    chars = Counter()
    for r in docs:
        chars[r["source"]] += len(r["text"])
    mean = sum(chars.values()) / len(chars)
    want = Counter({r["doc_id"]: quantile(uniform(17, r["doc_id"]), mean / chars[r["source"]]) for r in docs})
    assert Counter(r["doc_id"] for r in op4_poisson_mix(spark, SF).collect()) == +want
