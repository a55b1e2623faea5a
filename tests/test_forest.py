"""The hash-seeded forest against a plain recursive one, its search, and grouped curves."""

import hashlib
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from embercast.operators import curves, forest, split

S = forest.Settings(trees=3, max_depth=6, min_split=4, min_leaf=2, seed=5)
FEATURES = ["a", "b", "c"]


def rows(n=500, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.randint(0, 40) / 4, round(rng.gauss(0, 1), 2), float(rng.randint(0, 2))
        y = int(a + 3 * b + rng.gauss(0, 2) > 6)
        out.append((i, a, b, c, y))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "id int, a double, b double, c double, y int").repartition(3)


def plain(data, s, bins=32):
    """{tree: {node: (feature, threshold, n0, n1)}} by recursion over Python lists."""
    x = [[r[1], r[2], r[3]] for r in data]
    y, n, p = [r[4] for r in data], len(data), forest.PRIME
    key = [int(hashlib.md5(f"{r[0]}|{s.seed}".encode()).hexdigest()[:15], 16) % p for r in data]
    cuts = [sorted({sorted(v[f] for v in x)[i * n // bins] for i in range(1, bins)}) for f in range(3)]
    wanted = {"sqrt": 1, "log2": 1, None: 3}[s.max_features]
    out = {}
    for t in range(s.trees):
        a, b = forest.draw_factors(t, s.seed)
        times = [sum((k * a + b) % p >= d for d in forest.DRAWS) if s.bootstrap else 1 for k in key]
        n1, n0 = sum(m for m, v in zip(times, y) if v), sum(m for m, v in zip(times, y) if not v)
        if s.class_weight == "balanced":
            w = (n / (2 * y.count(0)), n / (2 * y.count(1)))
        else:
            w = ((n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)) if s.class_weight else (1.0, 1.0)
        nodes = out[t] = {}

        def grow(node, own, depth):
            m0, m1 = sum(times[i] for i in own if not y[i]), sum(times[i] for i in own if y[i])
            best = None
            if m0 and m1 and m0 + m1 >= s.min_split and depth < (s.max_depth or forest.DEEPEST):
                base = (node * 31 + t * 17 + s.seed * 13) % p
                for f in sorted(range(3), key=lambda f: ((base * (2654435 + f * 40503) + 12345 * f) % p, f))[:wanted]:
                    for cut in cuts[f]:
                        l0 = sum(times[i] for i in own if not y[i] and x[i][f] <= cut)
                        l1 = sum(times[i] for i in own if y[i] and x[i][f] <= cut)
                        if min(l0 + l1, m0 + m1 - l0 - l1) >= s.min_leaf:
                            a0, a1, b0, b1 = w[0] * l0, w[1] * l1, w[0] * (m0 - l0), w[1] * (m1 - l1)
                            score = (a0 * a0 + a1 * a1) / (a0 + a1) + (b0 * b0 + b1 * b1) / (b0 + b1)
                            if best is None or (-score, f, cut) < best:
                                best = (-score, f, cut)
            nodes[node] = (FEATURES[best[1]] if best else None, best[2] if best else None, m0, m1)
            if best:
                grow(2 * node, [i for i in own if x[i][best[1]] <= best[2]], depth + 1)
                grow(2 * node + 1, [i for i in own if x[i][best[1]] > best[2]], depth + 1)

        grow(1, [i for i in range(n) if times[i]], 0)
    return out


@pytest.mark.parametrize(("settings", "few", "open_nodes"), [
    (S, 4096, 8192), (replace(S, class_weight="balanced_subsample", max_features=None), 40, 3),
    (replace(S, max_depth=None, min_split=2, min_leaf=1, trees=2, bootstrap=False, class_weight="balanced"), 0, 8192)])
def test_grows_the_same_trees_as_plain_recursion(spark, settings, few, open_nodes):
    data = rows()
    model = forest.fit(frame(spark, data), FEATURES, "y", ["id"], settings, few_rows=few, open_nodes=open_nodes)
    got = {}
    for r in model.table(spark).collect():
        got.setdefault(r["tree"], {})[r["node"]] = (r["feature"], r["threshold"], r["n0"], r["n1"])
    assert got == plain(data, settings)


def test_does_not_depend_on_the_layout_and_scores_like_its_trees(spark):
    data = rows(300)
    df = frame(spark, data)
    one, two = (forest.fit(x, FEATURES, "y", ["id"], S) for x in (df, df.repartition(7, "b").sortWithinPartitions("c")))
    assert one.nodes == two.nodes
    got = {r["id"]: r["p"] for r in one.score(df, "p").collect()}
    for i, a, b, c, _ in data:
        values, shares = dict(zip(FEATURES, (a, b, c))), []
        for nodes in plain(data, S).values():
            n = 1
            while nodes[n][0]:
                n = 2 * n + (values[nodes[n][0]] > nodes[n][1])
            shares.append(nodes[n][3] / (nodes[n][2] + nodes[n][3]))
        assert math.isclose(got[i], sum(shares) / len(shares), rel_tol=1e-12)


def test_null_labels_and_values_one_class_and_empty(spark):
    df = frame(spark, [*rows(100), (1000, None, float("nan"), 1.0, None), (1001, 1.0, 1.0, 1.0, None)])
    model = forest.fit(df, FEATURES, "y", ["id"], S)
    assert model.nodes == forest.fit(frame(spark, rows(100)), FEATURES, "y", ["id"], S).nodes
    assert all(0 <= r["p"] <= 1 for r in model.score(df, "p").collect())
    ones = forest.fit(df.filter("y = 1"), FEATURES, "y", ["id"], S)
    assert {r["p"] for r in ones.score(df, "p").collect()} == {1.0} and ones.importance(spark).first()["importance"] == 0
    assert forest.fit(df.filter("false"), FEATURES, "y", ["id"], S).table(spark).count() == S.trees


def test_search_equals_separate_fits(spark):
    df = split.stratified_folds(frame(spark, rows(400)), "y", ["id"], 3, 1).cache()
    options = [S, replace(S, max_depth=2, bootstrap=False, max_features=None), replace(S, min_leaf=30, class_weight="balanced")]
    model, board = forest.search(df, FEATURES, "y", ["id"], options, "fold", 3)
    got = {r["candidate"]: r["fold_f1"] for r in board.collect()}
    cuts_of_all = forest.fit(df, FEATURES, "y", ["id"], S).cuts
    for i, s in enumerate(options):
        for k in range(3):
            alone = forest.fit(df, FEATURES, "y", ["id"], replace(s, without_fold=k), fold="fold")
            assert alone.cuts == cuts_of_all
            pred = alone.score(df.filter(F.col("fold") == k), "p").withColumn("pred", (F.col("p") > 0.5).cast("int"))
            f1 = {r["label"]: r["f1"] for r in curves.report(pred).collect()}["1"]
            assert math.isclose(got[i][k], f1, rel_tol=1e-12)
    best = board.first()["candidate"]
    assert model.nodes == forest.fit(df, FEATURES, "y", ["id"], options[best]).nodes


def test_learns_and_ranks_features(spark):
    df = frame(spark, rows(3000, 2))
    tr, te = df.filter("id % 4 > 0"), df.filter("id % 4 = 0")
    model = forest.fit(tr, FEATURES, "y", ["id"], forest.Settings(trees=30, max_depth=8))
    assert curves.roc_auc(model.score(te, "prob")).first()[0] > 0.85
    imp = {r["feature"]: r["importance"] for r in model.importance(spark).collect()}
    assert math.isclose(sum(imp.values()), 1) and imp["c"] < min(imp["a"], imp["b"])


def test_draws_are_poisson():
    rng = np.random.default_rng(0)
    times = forest.draws(rng.integers(0, forest.PRIME, 200_000), np.zeros(200_000), 3, S)
    for k in range(4):
        assert abs((times == k).mean() - math.exp(-1) / math.factorial(k)) < 0.005


def test_curves_by_group_equal_separate_curves(spark):
    rng = random.Random(3)
    data = [(rng.choice(["x", "y", None]), rng.randint(0, 1), round(rng.random(), 1)) for _ in range(600)]
    df = spark.createDataFrame([(g, y, p, int(p > 0.5)) for g, y, p in data], "g string, y int, prob double, pred int")
    whole = {
        "auc": curves.roc_auc(df, by=["g"]), "ap": curves.average_precision(df, by=["g"]), "pr": curves.pr_auc_trapezoid(df, by=["g"]),
        "metrics": curves.metrics(df, by=["g"]), "report": curves.report(df, by=["g"]), "confusion": curves.confusion(df, by=["g"]),
        "roc": curves.roc_points(df, by=["g"], partitions=5), "points": curves.pr_points(df, by=["g"])}
    alone = {
        "auc": curves.roc_auc, "ap": curves.average_precision, "pr": curves.pr_auc_trapezoid, "metrics": curves.metrics,
        "report": curves.report, "confusion": curves.confusion, "roc": curves.roc_points, "points": curves.pr_points}
    rounded = lambda t: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in t)
    for name, table in whole.items():
        got = table.collect()
        for g in ("x", "y", None):
            own = df.filter(F.col("g").eqNullSafe(F.lit(g)))
            assert rounded(tuple(r)[1:] for r in got if r["g"] == g) == rounded(map(tuple, alone[name](own).collect())), (name, g)


def test_rows_without_a_class_stay(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(30)], "id int, y int")
    test = split.stratified_split(df, "y", ["id"], 0.3).collect()
    assert len(test) == 30 and all((r["is_test"] is None) == (r["y"] is None) for r in test)
    folds = split.stratified_folds(df, "y", ["id"], 4).collect()
    assert len(folds) == 30 and all((r["fold"] is None) == (r["y"] is None) for r in folds)
    w = {r["y"]: r["weight"] for r in split.class_weights(df, "y").collect()}
    assert w == {None: 0.0, 0: 1.0, 1: 1.0}


def test_draws_by_cells_equal_the_thresholds():
    s, n = S, forest.PRIME
    a, b = forest.draw_factors(2, s.seed)
    back = pow(a, -1, n)
    near = [d + k for d in forest.DRAWS for k in (-1, 0, 1) if 0 <= d + k < n] + list(range(0, n, 9_999_991))
    rows = np.array([(v - b) * back % n for v in near], np.int64)
    assert forest.draws(rows, np.zeros(len(rows)), 2, s).tolist() == [sum(v >= d for d in forest.DRAWS) for v in near]


def test_candidates_share_the_binned_rows(spark, monkeypatch):
    from embercast.operators import model_queue

    made, plain_cuts = [], forest.cut_points
    monkeypatch.setattr(forest, "cut_points", lambda *a: made.append(1) or plain_cuts(*a))
    df = split.stratified_folds(frame(spark, rows(300)), "y", ["id"], 3, 1).cache()
    options = [replace(S, max_depth=2), replace(S, max_depth=3)]
    got = model_queue.run_queue(df, FEATURES, "y", ["id"], options, folds=3)
    assert len(made) == 1  # one set of cut points for all candidates, folds and refits
    for i, f in got.forests.items():
        assert f.nodes == forest.fit(df, FEATURES, "y", ["id"], options[i]).nodes


def no_fetching(monkeypatch):
    def fetched(self):
        raise AssertionError("the driver fetched a table of nodes")

    from pyspark.sql.classic.dataframe import DataFrame
    monkeypatch.setattr(DataFrame, "toArrow", fetched)


def test_importances_do_not_fetch_the_nodes(spark, monkeypatch):
    data, settings = rows(800), replace(S, max_depth=None, min_split=2, min_leaf=1, class_weight="balanced_subsample")
    no_fetching(monkeypatch)
    model = forest.fit(frame(spark, data), FEATURES, "y", ["id"], settings, few_rows=300)
    got = {r["feature"]: r["importance"] for r in model.importance(spark).collect()}
    share = dict.fromkeys(FEATURES, 0.0)
    for nodes in plain(data, settings).values():
        m0, m1 = nodes[1][2:]
        w0, w1 = (m0 + m1) / (2 * m0), (m0 + m1) / (2 * m1)
        pure = lambda n, w0=w0, w1=w1, nodes=nodes: ((w0 * nodes[n][2]) ** 2 + (w1 * nodes[n][3]) ** 2) / (w0 * nodes[n][2] + w1 * nodes[n][3])
        own = dict.fromkeys(FEATURES, 0.0)
        for n, x in nodes.items():
            if x[0]:
                own[x[0]] += pure(2 * n) + pure(2 * n + 1) - pure(n)
        for f in FEATURES:
            share[f] += own[f] / sum(own.values()) / settings.trees
    assert all(math.isclose(got[f], share[f], rel_tol=1e-9) for f in FEATURES)


def test_batches_do_not_change_the_subtrees(monkeypatch):
    rng = np.random.default_rng(3)
    n, settings = 4000, [replace(S, max_depth=None, min_split=2, min_leaf=1), replace(S, max_features=None)]
    rules, weights = forest.Rules(settings, [0, 1], 3), np.ones((2, 2))
    x, slot, y = rng.integers(0, 32, (n, 3)).astype(np.uint8), rng.integers(0, 2, n), rng.integers(0, 2, n)
    code, n1 = (2 + y).astype(np.uint8), np.bincount(slot, y, 2).astype(np.int64)
    ride = np.where(rng.random(n) < 0.2, np.arange(n), -1)
    code[ride >= 0] &= 1
    n1 = np.bincount(slot, (code == 3), 2).astype(np.int64)
    n0 = np.bincount(slot, (code == 2), 2).astype(np.int64)

    def grown():
        nodes, rides = {}, {}
        for part, _, out in forest._grown(np.array([1, 1]), np.array([0, 1]), n0, n1, slot, code, x, ride, 32, rules, weights):
            for t, k, *v in zip(*part, strict=True) if part is not None else ():
                nodes[int(t), int(k)] = tuple(map(int, v))
            for r, t, p in zip(*out, strict=True) if out is not None else ():
                assert r not in rides
                rides[int(r)] = int(t), float(p)
        return nodes, rides

    whole = grown()
    monkeypatch.setattr(forest, "BATCH_NODES", 3)
    monkeypatch.setattr(forest, "BATCH_ROWS", 50)
    assert grown() == whole and sorted(whole[1]) == np.flatnonzero(ride >= 0).tolist()
    for r, (t, p) in whole[1].items():
        k = 1
        while (v := whole[0][t, k])[0] >= 0:
            k = 2 * k + int(x[r, v[0]] > v[1])
        assert slot[r] == t and p == v[3] / (v[2] + v[3])


def test_search_scores_left_out_rows_without_fetching_the_nodes(spark, monkeypatch):
    df = split.stratified_folds(frame(spark, rows(400)), "y", ["id"], 3, 1).cache()
    options = [replace(S, max_depth=None, min_split=2, min_leaf=1), replace(S, max_features=None, bootstrap=False, trees=2)]
    want = []
    for s in options:
        own = []
        for k in range(3):
            alone = forest.fit(df, FEATURES, "y", ["id"], replace(s, without_fold=k), fold="fold")
            got = [(r["y"], r["p"] > 0.5) for r in alone.score(df.filter(F.col("fold") == k), "p").collect()]
            tp, wrong = got.count((1, True)), got.count((1, False)) + got.count((0, True))
            own.append(2 * tp / (2 * tp + wrong))
        want.append(own)
    no_fetching(monkeypatch)
    monkeypatch.setattr(forest, "CHUNK_ROWS", 50)
    monkeypatch.setattr(forest, "FEW_ROWS", 60)  # some rows end in upper nodes
    got = {r["candidate"]: r["fold_f1"] for r in forest.search(df, FEATURES, "y", ["id"], options, "fold", 3)[1].collect()}
    assert got == dict(enumerate(want))


def test_equal_trees_are_grown_once_and_counted_each(spark, monkeypatch):
    data, drawn, plain_draws = rows(300), [], forest._walks
    monkeypatch.setattr(forest, "_walks", lambda model, nodes: drawn.append({t for t, _ in nodes}) or plain_draws(model, nodes))
    s = replace(S, bootstrap=False, max_features=None, class_weight="balanced")
    model = forest.fit(frame(spark, data), FEATURES, "y", ["id"], [S, s], few_rows=100)
    assert set().union(*drawn) == {0, 1, 2, 3}  # of the second forest, which has trees 3, 4 and 5, one
    got, want = model.only(1), plain(data, s)
    assert got.nodes == [{n: (FEATURES.index(x[0]) if x[0] else -1, got.cuts[FEATURES.index(x[0])].index(x[1]) if x[0] else 0, *x[2:]) for n, x in want[t].items()} for t in range(3)]
    table = {(r["tree"], r["node"]): (r["feature"], r["threshold"], r["n0"], r["n1"]) for r in got.table(spark).collect()}
    assert table == {(t, n): x for t, nodes in want.items() for n, x in nodes.items()}
