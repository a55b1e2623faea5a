"""Substring dedup by words: repeated-phrase automata.

Windows of words that recur are confirmed in the shard of their anchor (see
``anchors``), an Aho-Corasick automaton of the confirmed phrases is compiled
for each part of a shard, and the text that every chunk has around a recurring
anchor is streamed through it to find all occurrences; the least document that
a phrase was found in keeps it. Words are compared exactly: a part gives each
distinct word one character (two, beyond a million words).
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from embercast.llm.anchors import Chunk, Units, find, grouped
from embercast.llm.arrays import mix, prefix_hash, span_hash

#: Windows in one automaton's part of a shard, about: a node's children are looked through one by one, and the
#: root has one for each word that begins a phrase, so small automata are much faster.
PART_WINDOWS = 8000
NOWHERE = np.iinfo(np.int64).max


def word_units(run: int):
    def units(texts: list[bytes]) -> Units:
        rows = [t.split() for t in texts]
        data = np.frombuffer(b"".join(b" ".join(r) + b" " if r else b"" for r in rows), np.uint8)
        end = np.flatnonzero(data == 32)
        start = np.append(0, end[:-1] + 1) if len(end) else end
        h = span_hash(prefix_hash(data), start, end)
        n = max(0, len(h) - run + 1)
        runs = np.zeros(n, np.uint64)
        for j in range(run):
            runs += h[j:j + n] * (mix(np.array([j + 1], np.uint64)) | np.uint64(1))
        first = np.append(0, np.cumsum([len(r) for r in rows], dtype=np.int64))
        return Units(data, first, start, end, mix(runs))

    return units


def lettered(codes: np.ndarray, kinds: int) -> tuple[str, int]:
    """Word numbers (of ``kinds`` words; 0 stands between texts) as a string with a fixed number of characters each."""
    if kinds <= 1_000_000:
        letters, width = codes + 1, 1
    else:
        letters, width = np.stack([(codes >> 16) + 1, (codes & 0xFFFF) + 1], axis=1).reshape(-1), 2
    letters = np.where(letters < 0xD800, letters, letters + 0x800)  # no surrogates
    return letters.astype("<u4").tobytes().decode("utf-32-le"), width


def phrase_hash(codes: np.ndarray, window: int) -> np.ndarray:
    """A hash of each ``window`` neighbours."""
    n = max(0, len(codes) - window + 1)
    h = np.zeros(n, np.uint64)
    c = mix(codes.astype(np.uint64) + np.uint64(1))
    for j in range(window):
        h += c[j:j + n] * (mix(np.array([j + 1], np.uint64)) | np.uint64(1))
    return mix(h)


def recurring(codes: np.ndarray, places: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """Places of phrases that two documents and more may share, one place for each phrase.

    Phrases are grouped by hash; a place whose words differ from its group's first is returned too."""
    h = phrase_hash(codes, window)[places]
    order = np.lexsort((docs, h))
    h, docs, places = h[order], docs[order], places[order]
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(h)))
    shared = docs[head] != docs[head + size - 1]
    first, member = np.repeat(places[head], size), np.repeat(shared, size)
    other, first = places[member], first[member]
    differs = np.zeros(len(other), bool)
    for j in range(window):
        differs |= codes[other + j] != codes[first + j]
    return np.concatenate([places[head[shared]], other[differs]])


def earlier_windows(window: int):
    def in_part(windows: np.ndarray, ids: np.ndarray, contents: list[bytes]) -> np.ndarray:
        """A mark for each window of each text in turn: whether it stands in a document with a smaller id too."""
        known: dict[bytes, int] = {}
        numbers, begin = [], []
        for c in contents:
            begin.append(len(numbers))
            numbers += [known.setdefault(w, len(known) + 1) for w in c.split(b" ")]
            numbers.append(0)
        codes = np.array(numbers, np.int64)
        place = np.repeat(np.array(begin, np.int64) - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
        doc = np.repeat(ids, windows)
        marks = np.zeros(len(place), bool)
        phrases = recurring(codes, place, doc, window)
        if len(phrases):
            text, width = lettered(codes, len(known) + 1)
            step, automaton = window * width, ahocorasick.Automaton()
            for k, at in enumerate((phrases * width).tolist()):
                automaton.add_word(text[at:at + step], k)
            automaton.make_automaton()
            found = np.array(list(automaton.iter(text)), np.int64).reshape(-1, 2)  # every occurrence in every text
            start = found[:, 0] + 1 - step
            start, phrase = start[start % width == 0] // width, found[start % width == 0, 1]
            of = np.full(len(codes), -1)
            of[place] = np.arange(len(place))
            of = of[start]
            least = np.full(len(phrases), NOWHERE)
            np.minimum.at(least, phrase, doc[of])
            marks[of[least[phrase] < doc[of]]] = True
        return marks

    def in_shard(chunks: list[tuple]) -> list[np.ndarray]:
        anchors, windows, ids = (np.concatenate([c[k] for c in chunks]) for k in (0, 1, 2))
        contents = [t for c in chunks for t in c[4]]
        parts = max(1, -(-int(windows.sum()) // PART_WINDOWS))
        part_of = mix(anchors.astype(np.uint64)) % np.uint64(parts)
        ends = np.cumsum(windows)
        marks = np.zeros(int(windows.sum()), bool)
        for mine in grouped(part_of):  # equal windows have equal anchors, and so meet in one part
            size = windows[mine].astype(np.int64)
            at = np.repeat(ends[mine] - np.cumsum(size), size) + np.arange(int(size.sum()))
            marks[at] = in_part(size, ids[mine], [contents[i] for i in mine.tolist()])
        return np.split(marks, np.cumsum([int(c[1].sum()) for c in chunks])[:-1])

    return in_shard


def kept_words(chunk: Chunk, gone: np.ndarray) -> dict[str, pa.Array]:
    kept, n_words, n_removed, spans = [], [], [], []
    first = chunk.units.first.tolist()
    for i, (t, a, b) in enumerate(zip(chunk.texts, first[:-1], first[1:], strict=True)):
        own = t.split()
        g = gone[a:b]
        n_words.append(len(own))
        n_removed.append(int(g.sum()))
        if n_removed[-1]:
            own = [own[j] for j in np.flatnonzero(~g).tolist()]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
            spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
        else:
            spans.append([])
        kept.append(b" ".join(own).decode())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return {"kept_text": pa.array(kept, pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "removed": pa.array(spans, kind)}


def remove_phrases(df: DataFrame, window: int = 13, run: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with kept_text (kept words joined by one space), n_words, n_removed and removed (word spans).

    A word goes if a window of ``window`` words covers it whose words also
    stand in a row in a document with a smaller doc_id; all windows are judged
    on the input. ``run`` (at most ``window``) is the length of the runs that
    anchors come from. Null text has no words. A row with a null doc_id takes
    no part and stays whole; rows of equal doc_id count as one document. All
    rows and columns stay, but columns of these four names are replaced, and one
    called _chunk is lost. An empty table stays empty. One text must fit in a worker's memory some sixty times over.
    """
    added = {"kept_text": "string", "n_words": "bigint", "n_removed": "bigint", "removed": "array<struct<start:bigint,end:bigint>>"}
    return find(df, word_units(run), window, run, earlier_windows(window), kept_words, added, True, doc_id, text)
