"""Phrase, suffix and near-duplicate removal against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from embercast.llm import anchors, arrays, minhash, phrases, suffix_dedup
from embercast.llm.components import components
from embercast.llm.queries import op6_phrase_automata, op7_induced_suffixes, op10_fast_sketch
from tests.llm.helpers import WORD, documents, frame, prose


def phrase_marks(rows, window):
    """(doc, text) -> marks of removed words; rows of one doc count as one document."""
    least = {}
    for doc, text in rows:
        w = WORD.findall(text or "")
        for j in range(len(w) - window + 1 if doc is not None else 0):
            k = tuple(w[j:j + window])
            least[k] = min(doc, least.get(k, doc))
    out = {}
    for doc, text in rows:
        w = WORD.findall(text or "")
        marks = [False] * len(w)
        for j in range(len(w) - window + 1 if doc is not None else 0):
            if least[tuple(w[j:j + window])] < doc:
                marks[j:j + window] = [True] * window
        out[doc, text] = (w, marks)
    return out


def byte_marks(rows, window):
    least = {}
    for doc, text in rows:
        b = (text or "").encode()
        for j in range(len(b) - window + 1 if doc is not None else 0):
            k = b[j:j + window]
            least[k] = min((doc, j), least.get(k, (doc, j)))
    out = {}
    for doc, text in rows:
        b = (text or "").encode()
        marks = [False] * len(b)
        for j in range(len(b) - window + 1 if doc is not None else 0):
            if least[b[j:j + window]] < (doc, j):
                marks[j:j + window] = [True] * window
        out[doc, text] = (b, marks)
    return out


@pytest.mark.parametrize("part", [8000, 50])
def test_phrases_on_documents(spark, monkeypatch, part):
    monkeypatch.setattr(phrases, "PART_WINDOWS", part)
    rows = documents(n=80)
    want = phrase_marks([r[:2] for r in rows], 13)
    got = phrases.remove_phrases(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r["n_removed"] for r in got) > 500
    for r in got:
        words, marks = want[r["doc_id"], r["text"]]
        assert r["kept_text"] == " ".join(w for w, m in zip(words, marks) if not m)
        assert (r["n_words"], r["n_removed"]) == (len(words), sum(marks))
        spans = [i for x in r["removed"] for i in range(x["start"], x["end"])]
        assert spans == [i for i, m in enumerate(marks) if m]


def test_phrases_with_two_characters_a_word(monkeypatch):
    rng = random.Random(3)
    codes = np.array([rng.randrange(1, 70_000) for _ in range(500)] + [0xD7FE, 0xD7FF, 0xDFFF, 0])
    one, width = phrases.lettered(codes, 70_000)
    assert width == 1 and len(one) == len(codes) and len(set(one)) == len(set(codes.tolist()))
    two, width = phrases.lettered(np.append(codes, 1_000_000), 1_000_001)
    assert width == 2 and len({two[i:i + 2] for i in range(0, len(two), 2)}) == len(set(codes.tolist())) + 1
    words = [b"w%d" % rng.randrange(30) for _ in range(60)]
    chunks = [(np.array([7, 7], np.uint32), np.array([3, 8], np.int32), np.array([1, 5]), np.array([0, 0]), [b" ".join(words[4:19]), b" ".join(words[:20])])]
    want = [False] * 3 + [4 <= j < 7 for j in range(8)]
    assert phrases.earlier_windows(13)(chunks)[0].tolist() == want
    plain = phrases.lettered
    monkeypatch.setattr(phrases, "lettered", lambda codes, kinds: plain(codes, 1_000_001))
    assert phrases.earlier_windows(13)(chunks)[0].tolist() == want


def test_phrases_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(phrases, "phrase_hash", lambda codes, window: np.zeros(max(0, len(codes) - window + 1), np.uint64))
    rng = random.Random(4)
    words = [b"w%d" % rng.randrange(9) for _ in range(40)]
    chunks = [(np.array([7, 7, 7], np.uint32), np.array([3, 8, 3], np.int32), np.array([1, 5, 9]), np.zeros(3, np.int64), [b" ".join(words[4:19]), b" ".join(words[:20]), b" ".join(words[20:35])])]
    assert phrases.earlier_windows(13)(chunks)[0].tolist() == [False] * 3 + [4 <= j < 7 for j in range(8)] + [False] * 3


def test_equal_segments_of_two_chunks_go_through_the_suffix_sort(monkeypatch):
    rng = random.Random(5)
    data = bytes(rng.randrange(97, 123) for _ in range(140))
    chunk = lambda doc: (np.array([7], np.uint32), np.array([41], np.int32), np.array([doc]), np.array([3]), [data])
    seen = []
    sort = suffix_dedup.equal_windows
    monkeypatch.setattr(suffix_dedup, "equal_windows", lambda text, window, folder: (seen.append(len(text)), sort(text, window, folder))[1])
    marks = suffix_dedup.earlier_windows(100, None)([chunk(4), chunk(2)])
    assert seen == [2 * 141 + 1] and marks[0].all() and not marks[1].any()
    # of a longer segment only the part with recurring windows is sorted
    longer = (np.array([7], np.uint32), np.array([61], np.int32), np.array([9]), np.array([0]), [b"0123456789" + data + b"9876543210"])
    marks = suffix_dedup.earlier_windows(100, None)([chunk(4), longer])
    assert seen[1:] == [2 * 141 + 1] and not marks[0].any() and marks[1].tolist() == [10 <= j < 51 for j in range(61)]


@pytest.mark.parametrize("alphabet", [b"ab", b"\x00\x01\xf4", b"\x00\xfd\xfe\xff"])
def test_marks_of_a_shard_against_brute_force(alphabet):
    rng = random.Random(11)
    for _ in range(60):
        chunks, first = [], {}
        for _ in range(rng.randint(1, 3)):
            n = rng.randint(1, 5)
            ids, starts = [rng.randint(-2, 4) for _ in range(n)], [rng.randint(0, 30) for _ in range(n)]
            texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(4, 40))) * rng.choice([1, 1, 3]) for _ in range(n)]
            chunks.append((np.full(n, 7, np.uint32), np.array([len(t) - 3 for t in texts], np.int32), np.array(ids), np.array(starts), texts))
        for _, _, ids, starts, texts in chunks:
            for d, s, t in zip(ids.tolist(), starts.tolist(), texts, strict=True):
                for j in range(len(t) - 3):
                    first[t[j:j + 4]] = min(first.get(t[j:j + 4], (d, s + j)), (d, s + j))
        got = suffix_dedup.earlier_windows(4, None)(chunks)
        for (_, _, ids, starts, texts), marks in zip(chunks, got, strict=True):
            want = [first[t[j:j + 4]] < (d, s + j) for d, s, t in zip(ids.tolist(), starts.tolist(), texts, strict=True) for j in range(len(t) - 3)]
            assert marks.tolist() == want


def test_suffix_order_against_sorting():
    rng = random.Random(6)
    for _ in range(800):
        n, kinds, most = rng.randint(1, 60), rng.choice([1, 2, 4]), rng.choice([2, 4, 9, 20])
        t = [rng.randint(1, kinds) for _ in range(n)] * rng.choice([1, 1, 4])
        order, shared = suffix_dedup.suffix_order(np.array([*t, 0], rng.choice([np.uint8, np.uint16])), most)
        assert sorted(order.tolist()) == list(range(len(t)))
        for i in range(1, len(order)):
            a, b = t[order[i - 1]:] + [0], t[order[i]:] + [0]
            assert a[:most] >= b[:most]
            same = next((k for k in range(most) if k >= len(a) or k >= len(b) or a[k] != b[k]), most)
            assert shared[i] == same


def test_suffix_order_with_the_queue_on_disk(tmp_path, monkeypatch):
    rng = random.Random(2)
    t = np.array([rng.randint(1, 3) for _ in range(3000)] + [0], np.uint16)
    want = suffix_dedup.suffix_order(t, 30)
    made = []
    init = suffix_dedup.SuffixQueue.__init__
    monkeypatch.setattr(suffix_dedup.SuffixQueue, "__init__", lambda self, symbols, folder, most=0: init(self, symbols, folder, 64))
    spill = suffix_dedup.SuffixQueue.spill
    monkeypatch.setattr(suffix_dedup.SuffixQueue, "spill", lambda self: (made.append(1), spill(self)))
    got = suffix_dedup.suffix_order(t, 30, str(tmp_path / "queue"))
    assert made and all((a == b).all() for a, b in zip(got, want))
    assert not list((tmp_path / "queue").iterdir())


def test_a_part_of_the_default_size_uses_the_disk_and_is_read_run_by_run(tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    text = rng.integers(2, 60, 1_500_000).astype(np.uint16)
    text[400_000:400_500] = text[1_000_000:1_000_500] = text[500:1000]
    text = np.append(text, [1, 0]).astype(np.uint16)
    assert len(text) < suffix_dedup.PART_BYTES
    spilled = []
    spill = suffix_dedup.SuffixQueue.spill
    monkeypatch.setattr(suffix_dedup.SuffixQueue, "spill", lambda self: (spilled.append(1), spill(self)))
    order, group = suffix_dedup.equal_windows(text, 100, str(tmp_path / "queue"))
    assert spilled and not list((tmp_path / "queue").iterdir())
    starts = [500, 400_000, 1_000_000]
    want = sorted(tuple(x + i for x in starts) for i in range(401))
    got = [tuple(sorted(order[group == g].tolist())) for g in np.unique(group)]
    assert sorted(got) == want


def test_a_shard_is_sorted_within_bounded_memory(tmp_path):
    rng = np.random.default_rng(8)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(900)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 900, 40))[:140].ljust(140, b".") for _ in range(11_000)]
    chunk = lambda doc: (np.arange(11_000, dtype=np.uint32), np.full(11_000, 41, np.int32), np.full(11_000, doc), 200 * np.arange(11_000), texts)
    chunks = [chunk(4), chunk(2)]
    tracemalloc.start()
    try:
        marks = suffix_dedup.earlier_windows(100, str(tmp_path / "queue"))(chunks)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert marks[0].all() and not marks[1].any()
    assert peak < 160 << 20, peak


def test_names_that_cover_the_window_are_not_sorted_on(monkeypatch):
    rng = np.random.default_rng(3)
    text = np.append(np.tile(rng.integers(2, 30, 4000), 3), 0).astype(np.uint8)
    sizes = []
    sort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: (sizes.append(len(x)) if x.dtype == np.int64 and not k else None, sort(x, *a, **k))[1])
    lms, least = suffix_dedup.sorted_lms(text, suffix_dedup.rising(text), 100, None)
    monkeypatch.undo()
    assert sum(sizes) < 3 * len(lms)
    for a, b, known in zip(lms[:-1].tolist(), lms[1:].tolist(), least[1:].tolist(), strict=True):
        assert (text[a:a + known] == text[b:b + known]).all() and known <= 100
    assert (least == 100).sum() > len(lms) // 2


@pytest.mark.parametrize("part", [12 << 20, 3000])
def test_suffixes_on_documents(spark, monkeypatch, part):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", part)
    rows = documents(n=80)
    rows.append((2000, "ab" * 400 + rows[0][1] + "ab" * 300, "en", "src0", 1))
    rows.append((2001, "x" * 1000, "en", "src0", 1))
    want = byte_marks([r[:2] for r in rows], 100)
    df = frame(spark, [(*r, "old") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, removed string")
    got = suffix_dedup.remove_repeats(df).collect()
    assert len(got) == len(rows)
    for r in got:
        data, marks = want[r["doc_id"], r["text"]]
        assert bytes(r["kept_bytes"]) == bytes(b for b, m in zip(data, marks) if not m), r["doc_id"]
        assert (r["n_bytes"], r["n_removed"]) == (len(data), sum(marks))
        assert [i for x in r["removed"] for i in range(x["start"], x["end"])] == [i for i, m in enumerate(marks) if m]


@pytest.mark.parametrize("kind", ["words", "bytes"])
def test_a_passage_beside_other_text_each_time_is_dealt_over_many_groups(spark, monkeypatch, kind):
    monkeypatch.setattr(anchors, "HOT_SEGMENTS", 30, raising=False)
    monkeypatch.setattr(anchors, "CHUNK_BYTES", 20_000)
    rng = random.Random(9)
    passage = prose(rng, 30)
    rows = [(i, f"{prose(rng, 25)} {passage} {prose(rng, 25)}") for i in range(300)]
    rows += [(1000 + i, t[7:]) for i, (_, t) in enumerate(rows[:40])] + [(2000, rows[5][1]), (2001, "ab" * 200)]
    window, run = (13, 5) if kind == "words" else (100, 32)
    in_shard = phrases.earlier_windows(13) if kind == "words" else suffix_dedup.earlier_windows(100, None)

    def watched(chunks):
        held = {}
        for c in chunks:
            for anchor, text in zip(c[0].tolist(), c[4], strict=True):
                held.setdefault(anchor, set()).add(text)
        assert all(len(texts) <= 30 for texts in held.values()), max(map(len, held.values()))
        return in_shard(chunks)

    added = {"gone": "array<boolean>"}
    units = phrases.word_units(5) if kind == "words" else suffix_dedup.byte_units(32)

    def finish(chunk, gone):
        first = chunk.units.first.tolist()
        return {"gone": pa.array([gone[a:b].tolist() for a, b in zip(first[:-1], first[1:])], pa.list_(pa.bool_()))}

    got = anchors.find(frame(spark, rows, "doc_id long, text string"), units, window, run, watched, finish, added, kind == "words", "doc_id", "text").collect()
    want = phrase_marks(rows, 13) if kind == "words" else byte_marks(rows, 100)
    assert len(got) == len(rows) and sum(sum(r["gone"]) for r in got) > 5000
    for r in got:
        assert r["gone"] == want[r["doc_id"], r["text"]][1], r["doc_id"]


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert phrases.remove_phrases(empty).count() == suffix_dedup.remove_repeats(empty).count() == minhash.near_duplicates(empty).count() == 0


def shingles(text, k):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(rows, k, percent):
    """(doc, text) -> (shingles, smallest doc reachable), comparing all pairs."""
    sets = {(d, t): shingles(t, k) for d, t in rows}
    root = {r: r for r in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = [r for r in sets if r[0] is not None]
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for r in keys:
        least[find(r)] = min(r[0], least.get(find(r), r[0]))
    return {r: (len(sets[r]), None if r[0] is None else least[find(r)]) for r in sets}


def near_copies(seed, n, base_words, edits):
    rng = random.Random(seed)
    base = prose(rng, base_words).split(" ")
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10 ** 6)}"
        rows.append((i * 7 % 1009, " ".join(w)))
    return rows


SMALL_GROUPS = [(minhash.GROUP_BYTES, minhash.BLOCK_BYTES), (2500, 2000)]


@pytest.mark.parametrize(("group", "block"), SMALL_GROUPS)
def test_near_duplicates_on_documents(spark, monkeypatch, group, block):
    """Edits enough that many members of a bucket are not linked with its smallest, or with one another."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block)
    rows = [r[:2] for r in documents(n=60)] + [(3000 + d, t) for d, t in near_copies(1, 40, 150, 8)] + [(5000 + d, t) for d, t in near_copies(2, 30, 6, 1)]
    want = groups(rows, 4, 80)
    got = minhash.near_duplicates(frame(spark, rows, "doc_id long, text string"), k=4, group_bytes=group).collect()
    assert len(got) == len(rows)
    ids = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert ids == {(d, n, c, d is None or c == d) for (d, _), (n, c) in want.items()}
    assert len({c for _, _, c, _ in ids}) < len(rows) - 40


@pytest.mark.parametrize(("group", "block"), SMALL_GROUPS)
def test_texts_of_one_doc_id_keep_their_own_links(spark, monkeypatch, group, block):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block)
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(5, a), (5, b), (5, f"{c} tail"), (9, f"{a} more"), (12, f"{b} more"), (12, d), (3, f"{b} else"), (30, c), (31, f"{d} last"), (40, f"{d} end")]
    rows += [(5 + i % 3, t) for i, (_, t) in enumerate(near_copies(4, 24, 60, 4))]
    want = groups(rows, 4, 80)
    got = minhash.near_duplicates(frame(spark, rows, "doc_id long, text string"), k=4, group_bytes=group).collect()
    have = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got)
    assert have == sorted((i, want[i, t][0], want[i, t][1], want[i, t][1] == i) for i, t in rows)


def test_rows_grow_with_a_group_of_near_copies(spark, monkeypatch):
    """Near copies of one text, few of them linked: every table's rows grow in proportion, whatever the paths taken."""
    made = {}

    def counted(df, name):
        out = arrays.written(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "written", counted)
    rows = []
    for n in (300, 600):
        made.clear()
        few = near_copies(5, n, 60, 3)
        few = [(i, t) for i, (_, t) in enumerate(few)]
        want = groups(few, 4, 80)
        got = minhash.near_duplicates(frame(spark, few, "doc_id long, text string"), k=4).collect()
        assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, want[i, t][1]) for i, t in few}
        rows.append(dict(made))
    for name, n in rows[1].items():
        assert n <= 2.6 * rows[0].get(name, 0) + 50, (name, rows)  # a node has 32 bands, so 32 pivots at most


def test_between_finds_what_all_pairs_find():
    rng = random.Random(6)
    for _ in range(60):
        base = rng.sample(range(10 ** 6), 50)
        sets = []
        for _ in range(rng.randint(2, 40)):
            s = set(base)
            for _ in range(rng.randint(0, 5)):
                s.discard(rng.choice(base))
                s.add(rng.randrange(10 ** 6) if rng.random() < 0.6 else rng.randrange(8))
            sets.append(s)
        middle = set(rng.choice(sets)) if rng.random() < 0.8 else set()
        parts = [np.array(sorted(s ^ middle), np.uint64) for s in sets]
        labels = np.arange(len(sets))
        found = minhash.between(np.array([len(s) for s in sets]), labels, parts, 80)
        assert all(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for i, j in found)

        def classes(links, n=len(sets)):
            root = list(range(n))
            for _ in range(n):
                for i, j in links:
                    root[i] = root[j] = min(root[i], root[j])
            return root

        every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        assert classes(found) == classes(every)


def test_sketch_coordinates_agree_with_similarity():
    rng = np.random.default_rng(5)
    for size in (3, 40, 2000):
        agree = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 12 * size // 10, np.uint64)
            a, b = np.sort(pool[:11 * size // 10]), np.sort(pool[size // 10:])
            s = minhash.sketches([a, b])
            assert (s != np.iinfo(np.uint64).max).all()
            agree.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(agree)) < 0.05


def test_components_of_a_path_a_star_and_self_links(spark):
    links = [(i, i + 1) for i in range(100, 130)] + [(7, i) for i in range(200, 240)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == {i: 100 for i in range(100, 131)} | {i: 7 for i in range(200, 240)} | {7: 7}


def test_queries_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    text = dict(docs)
    want = phrase_marks(docs, 13)
    for r in op6_phrase_automata(spark, sf).collect():
        words, marks = want[r["doc_id"], text[r["doc_id"]]]
        assert tuple(r) == (r["doc_id"], len(words), sum(marks), sha(" ".join(w for w, m in zip(words, marks) if not m).encode()))
    want = byte_marks(docs, 100)
    for r in op7_induced_suffixes(spark, sf).collect():
        data, marks = want[r["doc_id"], text[r["doc_id"]]]
        runs = sum(m and not (i and marks[i - 1]) for i, m in enumerate(marks))
        assert tuple(r) == (r["doc_id"], len(data), sum(marks), runs, sha(bytes(b for b, m in zip(data, marks) if not m)))
    want = groups(docs, 4, 80)
    for r in op10_fast_sketch(spark, sf).collect():
        n, c = want[r["doc_id"], text[r["doc_id"]]]
        assert tuple(r) == (r["doc_id"], n, c, c == r["doc_id"])
