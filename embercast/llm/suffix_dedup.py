"""Substring dedup by bytes: suffix arrays by external induced sorting.

The shard of an anchor (see ``anchors``) holds the segments of bytes around it,
each as often as there are chunks with it. They are joined with a terminator after each, and the suffixes of
the whole are sorted by induction, common-prefix values included:

* suffixes that begin a rise after a fall (LMS) are sorted first: one induction
  sorts their substrings, these get names, and the string of names is sorted in
  turn; as only ``window`` bytes of order are needed, which hold at most
  window / 2 names, joining two or more neighbours at a step settles it soon,
* a scan in order then puts each suffix that is larger than its successor in
  its place, and a scan in reverse the others. A queue with a first-in
  first-out line for each leading symbol is the priority queue of the scan:
  what it holds are tuples of position and common prefix with the entry before.
  When a queue holds more than a bound, well below the suffixes of a part, its
  longest lines go to the shared folder.

Whole lines are taken and pushed at a time with numpy. Suffixes in a row that
have ``window`` bytes and more in common are equal windows; all but the
earliest are marked. They are picked out of the order while it is induced, so
the order of a whole part is never held. What is in memory: a shard's segments,
of one part the text, its two arrays of kinds and runs and its LMS positions,
the queue up to its bound (and a line that is taken), and the equal windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from embercast.llm.anchors import Chunk, Units, find, grouped
from embercast.llm.arrays import mix, prefix_hash, run_hash, span_hash, work_folder
from embercast.llm.token_files import store

#: Entries of the queue that stay in memory, and bytes of text that are sorted at a time.
QUEUE_ENTRIES, PART_BYTES = 1 << 18, 3 << 19
NOWHERE = np.iinfo(np.int64).max


class SuffixQueue:
    """Priority queue of suffix tuples: (symbol; order of arrival) is the priority.

    Arrivals of one call and symbol form a run. When more than ``most`` entries
    are held, the runs of the longest lines are written to ``folder``, one file
    a line, and read when their symbol comes up."""

    def __init__(self, symbols: int, folder: str | None, most: int = QUEUE_ENTRIES):
        self.lines: list[list] = [[] for _ in range(symbols)]
        self.loose = [0] * symbols  # entries of each line that are in memory
        self.held, self.most, self.folder = 0, most, folder

    def push(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.lines[symbol].append((positions, prefixes))
        self.loose[symbol] += len(positions)
        self.held += len(positions)
        if self.held > self.most and self.folder:
            self.spill()

    def spill(self) -> None:
        fs, base = store(self.folder)
        fs.create_dir(base, recursive=True)
        for symbol in sorted(range(len(self.lines)), key=lambda c: -self.loose[c]):
            if not self.loose[symbol] or self.held <= self.most // 2:
                break
            line, path = self.lines[symbol], f"{base}/{uuid.uuid4().hex}"
            files = sum(isinstance(r, str) for r in line)  # they come before the runs in memory
            positions, prefixes = (np.concatenate(x) for x in zip(*line[files:], strict=True))
            with fs.open_output_stream(path) as f:
                f.write(positions.astype("<i8").tobytes())
                f.write(prefixes.tobytes())
            self.held -= len(positions)
            self.loose[symbol] = 0
            line[files:] = [path]

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All that has arrived for a symbol, in order of arrival; None if nothing has."""
        line, self.lines[symbol] = self.lines[symbol], []
        self.held, self.loose[symbol] = self.held - self.loose[symbol], 0
        runs = []
        for r in line:
            if isinstance(r, str):
                fs, _ = store(self.folder)
                with fs.open_input_stream(r) as f:
                    data = f.read()
                fs.delete_file(r)
                n = len(data) // 9
                runs.append((np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, n, 8 * n)))
            else:
                runs.append(r)
        if len(runs) < 2:
            return runs[0] if runs else None
        return tuple(np.concatenate(x) for x in zip(*runs, strict=True))


def rising(text: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the next one.

    The last symbol must be smaller than all others; its suffix counts as rising."""
    up = np.append(text[:-1] < text[1:], True)
    level = np.flatnonzero(text[:-1] == text[1:])  # decided at the end of the run
    ends = np.flatnonzero(np.append(np.diff(level) != 1, True))
    if len(level):
        up[level] = np.repeat(up[level[ends] + 1], np.diff(ends, prepend=-1))
    return up


def in_a_row(text: np.ndarray, at: int, most: int) -> int:
    """How often the symbol at a place stands in a row from there (``most`` and more: ``most``)."""
    other = np.flatnonzero(text[at:at + most] != text[at])
    return int(other[0]) if len(other) else most


class Scan:
    """One direction of the induction: pushes predecessors of the given kind, with their common prefixes
    (without ``prefixed`` with zeros, where only the order counts)."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, symbols: int, most: int, folder: str | None, prefixed: bool = True):
        #: The symbol before each position, 0 where it isn't wanted. The last symbol is 0, so before the first position there is none.
        self.symbol_before, self.most, self.prefixed = np.roll(text * wanted, 1), most, prefixed
        self.queue = SuffixQueue(symbols, folder)
        #: Least common prefix met since the last push of each symbol.
        self.since = np.full(symbols, most, np.uint8)

    def take(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """The next entries of the order; prefixes[i] is what entry i shares with the entry before it."""
        symbol = self.symbol_before[positions]
        ok = np.flatnonzero(symbol)
        least = prefixes.min() if len(prefixes) else self.most
        if len(ok):
            symbol = symbol[ok]
            order = np.argsort(symbol, kind="stable")
            ok, symbol = ok[order], symbol[order]
            edges = np.concatenate([[0], np.flatnonzero(symbol[1:] != symbol[:-1]) + 1, [len(symbol)]])
            seen, before = symbol[edges[:-1]], positions[ok] - 1
            shared = self.shared_with_last(prefixes, ok, edges, seen, least) if self.prefixed else np.zeros(len(ok), np.uint8)
            for s, a, b in zip(seen.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                self.queue.push(s, before[a:b], shared[a:b])
        else:
            self.since = np.minimum(self.since, least)

    def shared_with_last(self, prefixes: np.ndarray, ok: np.ndarray, edges: np.ndarray, seen: np.ndarray, least: int) -> np.ndarray:
        """What each pushed entry shares with the entry of its symbol pushed before it."""
        # before the first push of a symbol, and after its last, its running minimum goes on
        first, last = ok[edges[:-1]], ok[edges[1:] - 1]
        cuts = np.unique(np.concatenate([[0], first + 1, last + 1]))
        cuts = cuts[cuts < len(prefixes)]
        span = np.minimum.reduceat(prefixes, cuts)  # what lies between the places that are asked for
        low, rest = np.minimum.accumulate(span), np.append(np.minimum.accumulate(span[::-1])[::-1], np.uint8(self.most))
        shared = self.between(prefixes, ok, edges)
        shared[edges[:-1]] = np.minimum(self.since[seen], low[np.searchsorted(cuts, first + 1) - 1])
        self.since = np.minimum(self.since, least)
        self.since[seen] = rest[np.searchsorted(cuts, last + 1)]
        return np.minimum(shared + np.uint8(1), self.most).astype(np.uint8)

    def between(self, prefixes: np.ndarray, ok: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """For each pushed entry the least prefix since the entry of its symbol before it (the first of a symbol: its own)."""
        lo = np.append(0, ok[:-1] + 1)  # ranges of prefixes between two entries of one symbol
        lo[edges[:-1]] = ok[edges[:-1]]
        level = ((ok + 1 - lo).astype(np.float64).view(np.int64) >> 52) - 1023  # whole part of the logarithm
        n = len(prefixes)
        table = np.empty((int(level.max()) + 1, n), np.uint8)  # sparse table: least of 2**k prefixes from each place
        table[0] = prefixes
        for k in range(1, len(table)):
            half, last = 1 << k - 1, n - (1 << k) + 1
            np.minimum(table[k - 1, :last], table[k - 1, half:half + last], out=table[k, :last])
        table, row = table.ravel(), level * n
        return np.minimum(table[row + lo], table[row + ok + 1 - (1 << level)])


def induce(text: np.ndarray, seeds: np.ndarray, shared: np.ndarray, up: np.ndarray, most: int, folder: str | None, prefixed: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes but the terminator's in descending order, as pairs of positions and common prefixes
    with the entry before, from the LMS suffixes in ascending order and what each shares with the one before.
    Without ``prefixed`` the common prefixes mean nothing."""
    symbols = int(text.max()) + 1
    bounds = np.searchsorted(text[seeds], np.arange(symbols + 1))
    falls, scan = SuffixQueue(symbols, folder), Scan(text, ~up, symbols, most, folder, prefixed)
    for c in range(symbols):
        last = None
        while (got := scan.queue.pop(c)) is not None:
            positions, prefixes = got
            if last is None:
                prefixes = np.append(np.uint8(0), prefixes[1:])
            falls.push(c, positions, prefixes)
            scan.take(positions, prefixes)
            last = positions[-1]
        a, b = bounds[c], bounds[c + 1]
        if a < b:
            seam = 0 if last is None else min(in_a_row(text, last, most), in_a_row(text, seeds[a], most))
            scan.take(seeds[a:b], np.append(np.uint8(seam), shared[a + 1:b]))
    scan = Scan(text, up, symbols, most, folder, prefixed)
    for c in range(symbols - 1, -1, -1):
        last = None
        while (got := scan.queue.pop(c)) is not None:
            positions, prefixes = got
            if last is None:
                prefixes = np.append(np.uint8(0), prefixes[1:])
            scan.take(positions, prefixes)
            yield positions, prefixes
            last = positions[-1]
        if (got := falls.pop(c)) is not None:
            positions, prefixes = got
            seam = 0 if last is None else min(in_a_row(text, last, most), in_a_row(text, positions[-1], most))
            positions, prefixes = positions[::-1], np.append(np.uint8(seam), prefixes[:0:-1])
            scan.take(positions, prefixes)
            yield positions, prefixes


def common_prefixes(text: np.ndarray, order: np.ndarray, least: np.ndarray, most: int) -> np.ndarray:
    """What each suffix of ``order`` shares with the one before it, up to ``most`` symbols; ``least`` are known to be shared."""
    width = text.itemsize
    per = 8 // width
    padded = np.append(text, np.zeros(per, text.dtype))
    words = np.ndarray(len(text), "<u8", padded, strides=(width,)).copy()  # the symbols from each place on, as many as 8 bytes hold
    out = least.astype(np.int64)
    at = np.flatnonzero(out[1:] < most) + 1
    k = out[at]
    one, two = order[at] + k, order[at - 1] + k
    while len(at):  # a word at a time, then the equal symbols of the first that differs
        other = words[one] ^ words[two]
        differ = other != 0
        low = other[differ]
        out[at[differ]] = k[differ] + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) // (8 * width)
        go = np.flatnonzero(~differ)
        at, k, one, two = at[go], k[go] + per, one[go] + per, two[go] + per
        out[at] = k
        go = np.flatnonzero(k < most)
        at, k, one, two = at[go], k[go], one[go], two[go]
    return np.minimum(out, most).astype(np.uint8)


def sorted_lms(text: np.ndarray, up: np.ndarray, most: int, folder: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The LMS suffixes in order of their first ``most`` symbols and more, and how many symbols each is known
    to share with the one before at least."""
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    n = len(lms)
    seeds = lms[np.argsort(text[lms], kind="stable")]
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    # a first induction, from seeds in order of their first symbol alone, sorts the substrings from one LMS position to the next
    parts = [p[is_lms[p]] for p, _ in induce(text, seeds, np.zeros(n, np.uint8), up, most, folder, False)]
    order = np.append(np.concatenate(parts), len(text) - 1)[::-1]
    number = np.zeros(len(text), np.int32)
    number[lms] = np.arange(n)
    order = number[order]
    del parts, seeds, number, is_lms
    h = span_hash(prefix_hash(text), lms, np.append(lms[1:] + 1, len(text)))[order]  # of the substrings with their lengths
    fresh = np.append(True, h[1:] != h[:-1])
    names = np.empty(n, np.int32)
    names[order] = np.cumsum(fresh, dtype=np.int32) - 1
    del h
    # the string of names: each step joins as many neighbours as fit into a number. Of equal names only those go on that
    # cover less than ``most`` symbols; from the first step on a name is the first place of its equals in the order
    spanned = lambda i, count: np.minimum(lms[np.minimum(i + count, n - 1)] - lms[i] + 1, most).astype(np.uint8)  # noqa: E731  to the next one's first symbol
    covered, least, at = 1, np.zeros(n, np.uint8), np.arange(0 if fresh.all() else n, dtype=np.int32)
    while len(at):
        mine = np.sort(order[at])  # by place in the text, as their neighbours are looked up
        kinds = int(names.max()) + 2
        joined, values = max(2, 63 // kinds.bit_length()), names[mine].astype(np.int64)
        for k in range(covered, joined * covered, covered):
            inside = np.searchsorted(mine, n - k)
            values *= kinds
            values[:inside] += names[mine[:inside] + k] + 1
        turn = np.argsort(values)
        values = values[turn]
        new = np.append(True, values[1:] != values[:-1])
        told = np.flatnonzero(new & ~fresh)  # they differ only now
        least[at[told]] = spanned(mine, covered)[turn[told]]
        covered *= joined
        whole = (spanned(mine, covered) >= most)[turn] & ~(new & np.append(new[1:], True))
        mine = mine[turn]
        names[mine], order[at] = np.maximum.accumulate(np.where(new, at, 0)), mine
        least[at[whole & ~new]] = most
        on = np.flatnonzero(~whole & ~(new & np.append(new[1:], True)))
        at, fresh = at[on], new[on]
    return lms[order], least


def suffix_order(text: np.ndarray, most: int, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in descending order of their first ``most`` symbols, and what each shares with the one before
    (up to ``most``). The last symbol must be 0 and stand nowhere else; its own suffix is left out."""
    up = rising(text)
    lms, least = sorted_lms(text, up, most, folder)
    found = list(induce(text, lms, common_prefixes(text, lms, least, most), up, most, folder))
    return (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint8))


def equal_windows(text: np.ndarray, window: int, folder: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffixes in order those that share ``window`` symbols with a neighbour, and a number for each such group.

    The runs of the induction are looked at one by one; only what is returned is kept."""
    up = rising(text)
    lms, least = sorted_lms(text, up, window, folder)
    found, fresh = [], []
    last, follows = np.zeros(0, np.int64), np.zeros(0, bool)  # the latest entry, and whether it equals the one before
    for positions, prefixes in induce(text, lms, common_prefixes(text, lms, least, window), up, window, folder):
        positions, same = np.concatenate([last, positions]), np.concatenate([follows, prefixes >= window])
        member = np.flatnonzero(same[:-1] | same[1:])
        found.append(positions[member])
        fresh.append(~same[member])
        last, follows = positions[-1:].copy(), same[-1:].copy()
    found.append(last[follows])
    fresh.append(np.zeros(int(follows.sum()), bool))
    return np.concatenate(found), np.cumsum(np.concatenate(fresh))


def byte_units(run: int):
    def units(texts: list[bytes]) -> Units:
        data = np.frombuffer(b"".join(texts), np.uint8)
        first = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
        return Units(data, first, None, None, run_hash(prefix_hash(data), run))

    return units


def earlier_windows(window: int, folder: str | None):
    def in_part(windows: np.ndarray, ids: np.ndarray, starts: np.ndarray, contents: list[bytes]) -> np.ndarray:
        """A mark for each window of each segment in turn: whether it stands earlier in the part."""
        size = np.array([len(c) + 1 for c in contents])
        begin = np.cumsum(size) - size
        text = np.frombuffer(b"\0".join(contents) + b"\0\0", np.uint8)
        text = text + (np.uint8(2) if text.max() < 254 else np.uint16(2))  # no byte of UTF-8 is 254 or more
        text[begin + size - 1] = 1  # ends a segment; 0 ends the text
        text[-1] = 0
        _, rank = np.unique(ids, return_inverse=True)
        place = np.repeat((rank << 32) + starts - begin, size) + np.arange(len(text) - 1)  # document and place in it
        whole = np.arange(len(text) - 1) < np.repeat(begin + windows, size)  # a window of its segment begins here
        order, group = equal_windows(text, window, folder)
        use = np.flatnonzero(whole[order])
        marks = np.zeros(len(text) - 1, bool)
        if len(use):
            order, group = order[use], group[use]
            key = place[order]
            head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))  # the entries of a group stand in a row
            least = np.repeat(np.minimum.reduceat(key, head), np.diff(np.append(head, len(key))))
            marks[order[key != least]] = True
        return marks[whole]

    def in_cut(windows: np.ndarray, ids: np.ndarray, starts: np.ndarray, contents: list[bytes]) -> np.ndarray:
        """A mark for each window of each segment in turn: whether it stands earlier. Each segment is cut to what lies between its
        first and last window whose hash another window has too; a window with a hash of its own can't recur."""
        size = np.array([len(c) for c in contents])
        begin, ends = np.cumsum(size) - size, np.cumsum(windows, dtype=np.int64)
        first = ends - windows
        inner = np.arange(int(ends[-1])) - np.repeat(first, windows)
        at = np.repeat(begin, windows) + inner
        h = span_hash(prefix_hash(np.frombuffer(b"".join(contents), np.uint8)), at, at + window)
        order = np.argsort(h)
        h = h[order]
        same = np.concatenate([[False], h[1:] == h[:-1], [False]])
        recurs = np.zeros(len(h), bool)
        recurs[order] = same[1:] | same[:-1]
        low = np.minimum.reduceat(np.where(recurs, inner, NOWHERE), first)
        high = np.maximum.reduceat(np.where(recurs, inner, -1), first) + 1
        marks = np.zeros(len(h), bool)
        mine = np.flatnonzero(high > 0)
        if len(mine):
            low, high = low[mine], high[mine]
            cut = [contents[i][a:b + window - 1] for i, a, b in zip(mine.tolist(), low.tolist(), high.tolist(), strict=True)]
            n = high - low
            at = np.repeat(first[mine] + low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            marks[at] = in_part(n, ids[mine], starts[mine] + low, cut)
        return marks

    def in_shard(chunks: list[tuple]) -> list[np.ndarray]:
        anchors, windows, ids, starts = (np.concatenate([c[k] for c in chunks]) for k in range(4))
        contents = [t for c in chunks for t in c[4]]
        # every chunk's segments enter the sort, equal ones too
        size = np.fromiter(map(len, contents), np.int64, len(contents))
        parts = max(1, -(-int(size.sum()) // PART_BYTES))
        part_of = mix(anchors.astype(np.uint64)) % np.uint64(parts)
        first = np.cumsum(windows, dtype=np.int64) - windows
        marks = np.zeros(int(windows.sum()), bool)
        for mine in grouped(part_of):  # equal windows have equal anchors, and so meet in one part
            n = windows[mine]
            at = np.repeat(first[mine] - np.cumsum(n, dtype=np.int64) + n, n) + np.arange(int(n.sum()))
            marks[at] = in_cut(n, ids[mine], starts[mine], [contents[i] for i in mine.tolist()])
        return np.split(marks, np.cumsum([int(c[1].sum()) for c in chunks])[:-1])

    return in_shard


def kept_bytes(chunk: Chunk, gone: np.ndarray, as_text: bool = False) -> dict[str, pa.Array]:
    kept, n_bytes, n_removed, spans = [], [], [], []
    first = chunk.units.first.tolist()
    for t, a, b in zip(chunk.texts, first[:-1], first[1:], strict=True):
        g = gone[a:b]
        n_bytes.append(len(t))
        n_removed.append(int(g.sum()))
        own = []
        if n_removed[-1]:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
            own = [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()]
            t = np.frombuffer(t, np.uint8)[~g].tobytes()
        kept.append(t)
        spans.append(own)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    result = {"kept_text": pa.array([t.decode("utf-8", "ignore") for t in kept], pa.string())} if as_text else {"kept_bytes": pa.array(kept, pa.binary())}
    return result | {"n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "removed": pa.array(spans, kind)}


def remove_repeats(df: DataFrame, window: int = 100, run: int = 32, doc_id: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """``df`` with kept_bytes (the bytes that stay), n_bytes, n_removed and removed (byte spans).
    With ``as_text`` kept_text stands for kept_bytes: a string without characters that were cut.

    A byte of the UTF-8 text goes if a string of ``window`` bytes covers it that
    also starts earlier: in a row with a smaller doc_id, or before it in the
    same document. Strings never cross documents and are judged on the input.
    ``run`` (at most ``window``) is the length of the strings that anchors come
    from; ``window`` is 254 at most. Null text is empty. A row with a null
    doc_id takes no part and stays whole; rows of equal doc_id count as one
    document. All rows and columns stay, but columns of these four names are
    replaced, and one called _chunk is lost. An empty table stays empty. One
    text must fit in a worker's memory some sixty times over.
    """
    added = ({"kept_text": "string"} if as_text else {"kept_bytes": "binary"}) | {"n_bytes": "bigint", "n_removed": "bigint", "removed": "array<struct<start:bigint,end:bigint>>"}
    folder = work_folder(df.sparkSession, "suffix-queue")
    return find(df, byte_units(run), window, run, earlier_windows(window, folder), lambda c, g: kept_bytes(c, g, as_text), added, False, doc_id, text)
