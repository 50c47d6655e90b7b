"""External induced sorting of suffixes to a bounded depth, with common-prefix values.

Suffixes are of type L (greater than their successor suffix) or S; an S suffix after an L suffix is a seed. Substrings between
seeds are sorted and named, and the string of names is sorted by recursion, which orders the seeds. Then all L suffixes are
induced in ascending order and all S suffixes in descending order: each extracted suffix i pushes i - 1 into a priority queue, a tuple of
(symbol, position, common prefix with the one before it in that symbol: that of the two extracted suffixes, plus one).

The queue is disk-backed: tuples lie in runs sorted by symbol, in the order of arrival within a symbol; beyond the memory budget runs
go to an unlinked scratch file of the task, like Spark's own spills, and are gone with the task. Strings, types, seeds and sorted L
suffixes beyond a part of the budget lie in such files, too, and are mapped; what is computed on them is computed in steps. So a
string may be far longer than the budget. Names carry the common prefixes through the recursion: at the level above, two seeds that share so
many names are compared from there on.

Symbols are taken in buckets: a frequent symbol is one, rarer ones share one with some times the root of the string's length in suffixes. Within
a bucket of several symbols, suffixes are extracted together up to the first one that has to wait for a push.

Order and common prefixes are exact up to ``depth`` symbols; suffixes equal that far are in any order with the value ``depth``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Suffixes handled in one vectorised step.
STEP = 1 << 16
#: Names that are sorted directly, by prefix doubling.
BASE = 1 << 18
#: Tuples of the queue that wait unsorted, and runs that are merged into one.
WAITING, MOST_RUNS = 1 << 13, 48


@dataclass
class Counters:
    """What a sort did: levels of recursion, runs written to disk and arrays that lay in files."""

    levels: int = 0
    spilled: int = 0
    mapped: int = 0


class Space:
    """Arrays in memory, or in unlinked files where they are longer than a part of the budget."""

    def __init__(self, budget: int, counters: Counters | None = None):
        self.budget, self.counters = budget, counters or Counters()

    def array(self, n: int, kind) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.budget // 8:
            return np.empty(n, kind)
        self.counters.mapped += 1
        with tempfile.TemporaryFile() as f:  # the mapping keeps the file
            return np.asarray(np.memmap(f, kind, "w+", shape=(n,)))


def _chunks(n: int, step: int = STEP * 4) -> Iterator[tuple[int, int]]:
    for a in range(0, n, step):
        yield a, min(n, a + step)


class Queue:
    """A priority queue of (symbol, position, common prefix): least symbol first, then in the order of arrival."""

    def __init__(self, budget: int, kind, counters: Counters):
        self.budget, self.kind, self.counters = budget, kind, counters
        self.runs: list[list] = []  # [symbols, positions, prefixes, next, in memory]
        self.held, self.now = 0, 0  # bytes of runs in memory; symbols below were taken
        self.wait = (np.empty(WAITING, np.int32), np.empty(WAITING, kind), np.empty(WAITING, np.uint8))
        self.n = self.taken = 0

    def push(self, symbol: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Tuples in ascending order of symbols, none below those taken."""
        n = len(symbol)
        if self.n + n > WAITING or n > WAITING // 2:
            self._flush()
        if n > WAITING // 2:
            self._add(symbol.astype(np.int32), pos.astype(self.kind), lcp)
            return
        for to, values in zip(self.wait, (symbol, pos, lcp), strict=True):
            to[self.n : self.n + n] = values
        self.n += n

    def _flush(self) -> None:
        """Makes a run of the tuples that wait."""
        symbol, pos, lcp = (w[: self.n] for w in self.wait)
        left = symbol >= self.now
        left[: self.taken] &= symbol[: self.taken] > self.now
        order = np.flatnonzero(left)
        order = order[np.argsort(symbol[order], kind="stable")]
        if len(order):
            self._add(symbol[order], pos[order], lcp[order])
        self.n = self.taken = 0

    def _add(self, symbol: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.runs.append([symbol, pos, lcp, 0, True])
        self.held += symbol.nbytes + pos.nbytes + lcp.nbytes
        if self.held > self.budget:
            for run in self.runs:
                if run[4]:
                    self._spill(run)
            self.held = 0

    def _spill(self, run: list) -> None:
        rest = [x[run[3] :] for x in run[:3]]
        if len(rest[0]):
            with tempfile.TemporaryFile() as f:
                for x in rest:
                    f.write(x.tobytes())
                f.flush()
                at = 0
                for k, x in enumerate(rest):
                    run[k] = np.asarray(np.memmap(f, x.dtype, "r", offset=at, shape=x.shape))
                    at += x.nbytes
            self.counters.spilled += 1
        else:
            run[:3] = rest
        run[3], run[4] = 0, False

    def settle(self) -> None:
        """Between buckets: drops empty runs, and merges many into one on disk, a part of the symbols at a time."""
        self.runs = [r for r in self.runs if r[3] < len(r[0])]
        if len(self.runs) <= MOST_RUNS:
            return
        self._flush()
        symbol, pos, lcp = (x for x in zip(*[(r[0][r[3] :], r[1][r[3] :], r[2][r[3] :]) for r in self.runs], strict=True))
        total = sum(map(len, symbol))
        with tempfile.TemporaryFile() as s, tempfile.TemporaryFile() as p, tempfile.TemporaryFile() as c:
            at = [0] * len(symbol)
            while any(a < len(x) for a, x in zip(at, symbol, strict=True)):
                # up to the least last symbol among the next parts of the runs
                part = max(1, STEP // len(symbol))
                last = min(int(x[min(len(x), a + part) - 1]) for a, x in zip(at, symbol, strict=True) if a < len(x))
                upto = [a + int(np.searchsorted(x[a:], last, side="right")) for a, x in zip(at, symbol, strict=True)]
                pieces = [np.concatenate([x[a:b] for a, b, x in zip(at, upto, xs, strict=True)]) for xs in (symbol, pos, lcp)]
                order = np.argsort(pieces[0], kind="stable")
                for f, x in zip((s, p, c), pieces, strict=True):
                    f.write(x[order].tobytes())
                at = upto
            for f in (s, p, c):
                f.flush()
            self.runs = [[*(np.asarray(np.memmap(f, kind, "r", shape=(total,))) for f, kind in ((s, np.int32), (p, self.kind), (c, np.uint8))), 0, False]]
        self.held = 0
        self.counters.spilled += 1

    def stream(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, common prefixes) of a symbol in order of arrival, those pushed meanwhile included."""
        self.now, self.taken = symbol, 0
        k = 0
        while True:
            if k < len(self.runs):
                run = self.runs[k]
                end = run[3] + int(np.searchsorted(run[0][run[3] :], symbol, side="right"))
                while run[3] < end:
                    a, b = run[3], min(end, run[3] + STEP)
                    run[3] = b
                    out = np.array(run[1][a:b]), np.array(run[2][a:b])
                    moved = run[4]
                    yield out
                    if moved and not run[4]:  # it went to disk meanwhile, without what had been taken
                        end -= b
                k += 1
            else:
                new = self.taken + np.flatnonzero(self.wait[0][self.taken : self.n] == symbol)
                if not len(new):
                    return
                self.taken = self.n
                runs = len(self.runs)
                yield self.wait[1][new], self.wait[2][new]
                k = runs

    def take(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tuples with a symbol from low to high (exclusive), by symbol and arrival."""
        self.now = high
        parts = []
        for run in self.runs:
            end = run[3] + int(np.searchsorted(run[0][run[3] :], high, side="left"))
            if end > run[3]:
                parts.append([x[run[3] : end] for x in run[:3]])
                run[3] = end
        new = np.flatnonzero((self.wait[0][: self.n] >= low) & (self.wait[0][: self.n] < high))
        self.taken = 0  # nothing that waits has a symbol of ``now``
        if len(new):
            parts.append([w[new] for w in self.wait])
        if not parts:
            return np.empty(0, np.int32), np.empty(0, self.kind), np.empty(0, np.uint8)
        symbol, pos, lcp = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(symbol, kind="stable")
        return symbol[order], pos[order], lcp[order]


class _LeastBetween:
    """Minimum of lcp[a:b] for many ranges, by a sparse table over one step."""

    def __init__(self, lcp: np.ndarray):
        self.levels, width = [lcp], 1
        while 2 * width <= len(lcp):
            top = self.levels[-1]
            self.levels.append(np.minimum(top[:-width], top[width:]))
            width *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.uint8)
        for k in np.flatnonzero(np.bincount(level)).tolist() if len(level) else ():
            m = level == k
            top = self.levels[k]
            out[m] = np.minimum(top[a[m]], top[b[m] - (1 << k)])
        return out


class _Pass:
    """One direction of induction: extracts suffixes in order, pushes predecessors of one type.

    In the descending one symbols are counted from the top, so both take the least first.
    """

    def __init__(self, code: np.ndarray, top: int, kind: int, depth: int, space: Space, down: bool):
        self.code, self.top, self.kind, self.depth, self.down = code, top, kind, depth, down
        self.rest = np.full(top, depth, np.uint8)  # least common prefix since a symbol's last push, in the step of that
        self.step = np.full(top, -1, np.int32)  # the step of that, -1 before the first
        self.now = 0
        self.low = np.full(depth + 1, -1, np.int64)  # the last step in which a common prefix was so short
        self.queue = Queue(space.budget, np.int32 if len(code) < 1 << 31 else np.int64, space.counters)
        self.last = (-1, -1)  # twice the symbol (plus 1 for the second type) and position of the suffix extracted last

    def before(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the source, predecessor, its symbol) of the predecessors of this pass's type."""
        before = pos - 1
        code = self.code[before]  # that of the last suffix, for the first
        source = (((code & 1) == self.kind) & (pos > 0)).nonzero()[0]
        symbol = (code[source] >> 1).astype(np.int64)
        return source, before[source], self.top - 1 - symbol if self.down else symbol

    def extract(self, lcp: np.ndarray, source: np.ndarray, before: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tuples that suffixes push, which come next with the common prefixes with the one before, by symbol."""
        self.now += 1
        ahead = np.minimum.accumulate(lcp)
        shortest = int(ahead[-1])
        if not len(source):
            self.low[shortest] = self.now
            return symbol, before, lcp[:0]
        order = symbol.argsort(kind="stable")
        source, before, symbol = source[order], before[order], symbol[order]
        first = np.empty(len(symbol) + 1, bool)
        first[0] = first[-1] = True
        np.not_equal(symbol[1:], symbol[:-1], out=first[1:-1])
        heads, tails = first[:-1].nonzero()[0], first[1:].nonzero()[0]
        targets = symbol[heads]
        new = ahead[source]
        if len(heads) < len(symbol):
            more = (~first[:-1]).nonzero()[0]
            new[more] = _LeastBetween(lcp)(source[more - 1] + 1, source[more] + 1)
        # since the last push to a symbol: the rest of its step, and the steps after that
        was = self.step[targets]
        since = np.maximum.accumulate(self.low).searchsorted(was, side="right")
        new[heads] = np.minimum(new[heads], np.minimum(self.rest[targets], since))
        new = np.minimum(new, self.depth - 1) + np.uint8(1)
        new[heads[was < 0]] = 0  # the first suffix of its symbol and type
        self.step[targets] = self.now
        self.low[shortest] = self.now
        behind = np.empty(len(lcp) + 1, np.uint8)
        behind[-1] = self.depth
        np.minimum.accumulate(lcp[::-1], out=behind[-2::-1])
        self.rest[targets] = behind[source[tails] + 1]
        return symbol, before, new

    def borders(self, key: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        """Sets the common prefix where a symbol's second type begins after its first: the repeats of the symbol at the start of either.

        key: 2 * symbol, plus 1 for the second type.
        """
        at = (((key[1:] & 1) == 1) & (key[1:] == key[:-1] + 1)).nonzero()[0] + 1
        left = pos[at - 1]
        if key[0] & 1 and self.last[0] == key[0] - 1:
            at, left = np.append(0, at), np.append(self.last[1], left)
        if len(at):
            lcp = lcp.copy()
            lcp[at] = np.minimum(_repeats(self.code, left.astype(np.int64), self.depth), _repeats(self.code, pos[at].astype(np.int64), self.depth))
        self.last = (int(key[-1]), int(pos[-1]))
        return lcp

    def one(self, symbol: int, others: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(class, positions, common prefixes) of a symbol's suffixes: the queue's, then the others'."""
        for second, parts in ((0, self.queue.stream(symbol)), (1, others)):
            for pos, lcp in parts:
                lcp = self.borders(np.full(len(pos), 2 * symbol + second), pos, lcp)
                self.queue.push(*self.extract(lcp, *self.before(pos)))
                yield second, pos, lcp

    def several(self, low: int, high: int, symbol: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(class, positions, common prefixes) of a bucket of symbols: the queue's, and the given others, sorted by symbol."""
        q = self.queue.take(low, high)
        key = np.concatenate([2 * q[0].astype(np.int64), 2 * symbol.astype(np.int64) + 1])
        pos, lcp = np.concatenate([q[1], pos]), np.concatenate([q[2], lcp])
        order = key.argsort(kind="stable")
        key, pos, lcp = key[order], pos[order], lcp[order]
        while len(pos):
            source, before, target = self.before(pos)
            n = len(pos)
            within = target < high
            if within.any():  # up to the first that comes after a suffix pushed here
                first = np.full(n + 1, 2 * high)
                first[source[within] + 1] = 2 * target[within]
                wait = (key > np.minimum.accumulate(first)[:-1]).nonzero()[0]
                if len(wait):
                    n = int(wait[0])
                    now = int(source.searchsorted(n))
                    source, before, target = source[:now], before[:now], target[:now]
            done = self.borders(key[:n], pos[:n], lcp[:n])
            new = self.extract(done, source, before, target)
            yield key[:n] & 1, pos[:n], done
            own = int(new[0].searchsorted(high))
            if own < len(new[0]):
                self.queue.push(*(x[own:] for x in new))
            if own:
                key = np.concatenate([key[n:], 2 * new[0][:own]])
                order = key.argsort(kind="stable")
                key, pos, lcp = key[order], np.concatenate([pos[n:], new[1][:own]])[order], np.concatenate([lcp[n:], new[2][:own]])[order]
            else:
                key, pos, lcp = key[n:], pos[n:], lcp[n:]


def _repeats(code: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """How often the symbol at each place stands there in a row, up to most."""
    symbol = code[at] >> 1
    out = np.ones(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        next_ = at[live] + out[live]
        live = live[(next_ < len(code)) & (out[live] < most)]
        live = live[(code[at[live] + out[live]] >> 1) == symbol[live]]
        out[live] += 1
    return out.astype(np.uint8)


def _coded(text: np.ndarray, top: int, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """(2 * symbol + 1 for S or 0 for L, seeds). The last suffix is L; a run of equal symbols has the type of its last one."""
    n = len(text)
    code = space.array(n, np.uint16 if top < 1 << 15 else np.int32 if top < 1 << 30 else np.int64)
    is_s, after = False, -1  # type and symbol of the suffix after the chunk
    for a, b in reversed(list(_chunks(n))):
        t = text[a:b].astype(np.int64)
        turn = np.append(np.flatnonzero(t[1:] != t[:-1]), len(t) - 1)
        kind = np.append(t[turn[:-1]] < t[turn[:-1] + 1], is_s if t[-1] == after else t[-1] < after)
        s = np.repeat(kind, np.diff(np.concatenate([[-1], turn])))
        code[a:b] = 2 * t + s
        is_s, after = bool(s[0]), int(t[0])
    count = sum(int(((code[a + 1 : b + 1] & 1) > (code[a : min(b, n - 1)] & 1)).sum()) for a, b in _chunks(n))
    seeds, k = space.array(count, np.int64), 0
    for a, b in _chunks(n):
        found = np.flatnonzero((code[a + 1 : b + 1] & 1) > (code[a : min(b, n - 1)] & 1)) + a + 1
        seeds[k : k + len(found)] = found
        k += len(found)
    return code, seeds


def _words(code: np.ndarray, begin: np.ndarray, end: np.ndarray, at: int, per: int, bits: int) -> np.ndarray:
    """Symbols at to at + per of each substring as one number; a substring's end is below any symbol."""
    word = np.zeros(len(begin), np.int64)
    for j in range(per):
        p = begin + at + j
        inside = p < end
        word <<= bits
        word[inside] += code[p[inside]].astype(np.int64) + 1
    return word


def _named(code: np.ndarray, begin: np.ndarray, end: np.ndarray, at: int, per: int, bits: int) -> np.ndarray:
    """Dense ranks of substrings that agree up to at, in memory."""
    group = np.zeros(len(begin), np.int64)
    open_ = np.arange(len(begin))
    while len(open_):
        word = _words(code, begin[open_], end[open_], at, per, bits)
        order = np.lexsort((word, group[open_]))
        o = open_[order]
        g, w = group[o], word[order]
        fresh = np.concatenate([[True], g[1:] != g[:-1]])
        differ = fresh | np.concatenate([[True], w[1:] != w[:-1]])
        index = np.arange(len(o))
        # a group keeps the number of substrings before it, so groups split without renaming the others
        group[o] = g + np.maximum.accumulate(np.where(differ, index, 0)) - np.maximum.accumulate(np.where(fresh, index, 0))
        at += per
        heads = np.flatnonzero(differ)
        size = np.diff(np.append(heads, len(o)))
        goes_on = np.maximum.reduceat((begin[o] + at < end[o]).astype(np.int8), heads) > 0
        open_ = o[np.repeat((size > 1) & goes_on, size)]
    return np.unique(group, return_inverse=True)[1]


def _names(code: np.ndarray, seeds: np.ndarray, bits: int, space: Space) -> tuple[np.ndarray, int]:
    """(rank of each seed's substring, up to and with the next seed; number of ranks). 2 * symbol + type: so none is a prefix of another.

    More substrings than the budget holds are split by their first symbols, and so on.
    """
    per = max(1, 62 // bits)
    n = len(seeds)
    names, known = space.array(n, np.int64), 0
    fits = max(1024, space.budget // 96)

    def name(some: np.ndarray | None, at: int) -> None:
        nonlocal known
        count = n if some is None else len(some)
        pick = (lambda a, b: np.arange(a, b)) if some is None else (lambda a, b: np.asarray(some[a:b]))

        def ends(i: np.ndarray) -> np.ndarray:
            return np.where(i + 1 < n, seeds[np.minimum(i + 1, n - 1)] + 1, len(code))

        if count <= fits:
            i = pick(0, count)
            rank = _named(code, seeds[i], ends(i), at, per, bits)
            names[i] = rank + known
            known += int(rank.max()) + 1
            return
        word = space.array(count, np.int64)
        goes_on = False
        for a, b in _chunks(count):
            i = pick(a, b)
            word[a:b] = _words(code, seeds[i], ends(i), at, per, bits)
            goes_on |= bool((seeds[i] + at + per < ends(i)).any())
        pivots = np.unique(np.asarray(word[:: max(1, count // 4096)]))
        pivots = pivots[:: max(1, len(pivots) // (2 * (count // fits + 1)))]
        if len(pivots) == 1 and all((word[a:b] == pivots[0]).all() for a, b in _chunks(count)):
            if goes_on:
                name(some, at + per)
            else:
                for a, b in _chunks(count):
                    names[pick(a, b)] = known
                known += 1
            return
        # parts: below the first pivot, a pivot itself, between it and the next, and so on
        for k in range(2 * len(pivots) + 1):
            low, high = pivots[k // 2 - 1] if k > 1 or k == 1 else None, pivots[k // 2] if k // 2 < len(pivots) else None
            if k % 2:  # the pivot number k // 2
                chosen = [pick(a, b)[np.asarray(word[a:b]) == pivots[k // 2]] for a, b in _chunks(count)]
            else:
                low = pivots[k // 2 - 1] if k else np.iinfo(np.int64).min
                high = pivots[k // 2] if k // 2 < len(pivots) else np.iinfo(np.int64).max
                chosen = [pick(a, b)[(np.asarray(word[a:b]) > low) & (np.asarray(word[a:b]) < high)] for a, b in _chunks(count)]
            size = sum(map(len, chosen))
            if size:
                part = space.array(size, np.int64)
                part[:] = np.concatenate(chosen)
                name(part, at)

    if n:
        name(None, 0)
    return names, known


def _doubling(names: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes of names by their first ``most`` symbols at least, by prefix doubling."""
    n = len(names)
    rank, width = np.unique(names, return_inverse=True)[1].astype(np.int64) + 1, 1
    while True:
        order = np.argsort(rank)
        sorted_rank = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], (sorted_rank[1:] != sorted_rank[:-1]).astype(np.int64)]))
        if new[order[-1]] == n or width >= most:
            return order
        second = np.zeros(n, np.int64)
        second[: max(0, n - width)] = new[width:] if width < n else 0
        rank = new * (n + 1) + second
        width *= 2


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of suffix pairs that are known to share so much, up to depth."""
    out = known.copy()
    live, n = np.arange(len(a)), len(text)
    if text.dtype == np.uint8 and n >= 16:  # bytes are compared eight at a time
        words = np.ndarray(n - 7, np.dtype("<u8"), text, strides=(1,))
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            inside = (np.maximum(x, y) < len(words)) & (out[live] < depth)
            live, x, y = live[inside], x[inside], y[inside]
            differ = words[x] ^ words[y]
            same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
            out[live] += same
            live = live[differ == 0]
        live = np.flatnonzero(np.maximum(a, b) + out >= n - 7)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = (x < n) & (y < n) & (out[live] < depth)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
        out[live] += 1
    return np.minimum(out, depth)


def _seeds_in_order(text: np.ndarray, code: np.ndarray, seeds: np.ndarray, depth: int, space: Space, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(seeds by their suffixes, common prefix of each with the one before). Two seeds are two symbols apart at least, so half as many names cover depth."""
    n = len(seeds)
    order, lcp = space.array(n, np.int64), space.array(n, np.uint8)
    if not n:
        return order, lcp
    names, known = _names(code, seeds, (2 * (int(code.max()) // 2) + 3).bit_length(), space)
    shared = None  # names that neighbours share, where the recursion tells
    if known == n:
        for a, b in _chunks(n):
            order[names[a:b]] = np.arange(a, b)
    elif n <= BASE:
        order[:] = _doubling(np.asarray(names), depth // 2 + 1)
    else:
        shared = space.array(n, np.uint8)
        at = n
        for pos, above in induced(names, depth // 2 + 1, space.budget, space.counters, level + 1):
            order[at - len(pos) : at] = pos[::-1]
            # from "with the one above" to "with the one before": a value belongs to the one above
            stop = min(n, at + 1)
            shared[at - len(pos) + 1 : stop] = above[::-1][: stop - (at - len(pos) + 1)]
            at -= len(pos)
    for a, b in _chunks(n):
        i, j = order[max(0, a - 1) : b - 1], order[max(a, 1) : b]
        x, y = seeds[i], seeds[j]
        start = np.zeros(len(x), np.int64)
        if shared is not None:
            m = shared[max(a, 1) : b].astype(np.int64)
            most = np.minimum(m, np.minimum(n - 1 - i, n - 1 - j))  # the last name ends with the string
            start = np.minimum(seeds[j + most] - y, depth)
        lcp[max(a, 1) : b] = _common(text, x, y, start, depth)
    lcp[0] = 0
    for a, b in _chunks(n):
        order[a:b] = seeds[order[a:b]]
    return order, lcp


def _buckets(count: np.ndarray) -> list[tuple[int, int]]:
    """Symbols (first, end) that are taken together: a frequent one alone, rarer ones with about the root of all in suffixes."""
    size = max(1, 3 * int(np.sqrt(count.sum())))
    before = np.cumsum(count) - count
    alone = count > size
    cut = np.ones(len(count), bool)
    cut[1:] = (before[1:] // size != before[:-1] // size) | alone[1:] | alone[:-1]
    at = np.flatnonzero(cut)
    return list(zip(at.tolist(), [*at[1:].tolist(), len(count)], strict=True))


def induced(text: np.ndarray, depth: int, budget: int, counters: Counters | None = None, level: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (positions, common prefixes with the suffix above), from the greatest suffix down, in chunks.

    text: non-negative integers; depth: at most 255; budget: bytes of memory of a queue, and eight times that of an array.
    """
    n = len(text)
    if not n:
        return
    space = Space(budget, counters)
    space.counters.levels = max(space.counters.levels, level)
    top = max(int(text[a:b].max()) for a, b in _chunks(n)) + 1
    code, seeds = _coded(text, top, space)
    count = np.zeros(2 * top, np.int64)
    for a, b in _chunks(n):
        count += np.bincount(code[a:b], minlength=2 * top)
    order, seed_lcp = _seeds_in_order(text, code, seeds, depth, space, level)
    del seeds
    seed_count = np.zeros(top, np.int64)
    for a, b in _chunks(len(order)):
        seed_count += np.bincount(text[order[a:b]], minlength=top)
    seed_end = np.cumsum(seed_count)
    lower_end = np.cumsum(count[::2])
    buckets = _buckets(count[::2] + count[1::2])
    lower_pos, lower_lcp, done = space.array(int(lower_end[-1]), np.int32 if n < 1 << 31 else np.int64), space.array(int(lower_end[-1]), np.uint8), 0

    def parts(pos: np.ndarray, lcp: np.ndarray, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for x in range(a, b, STEP):
            yield np.asarray(pos[x : min(b, x + STEP)]), np.asarray(lcp[x : min(b, x + STEP)])

    up = _Pass(code, top, 0, depth, space, False)
    up.queue.push(np.array([int(text[-1])]), np.array([n - 1]), np.zeros(1, np.uint8))
    up.step[int(text[-1])] = 0
    for low, high in buckets:
        a, b = int(seed_end[low] - seed_count[low]), int(seed_end[high - 1])
        if high - low == 1:
            for second, pos, lcp in up.one(low, parts(order, seed_lcp, a, b)):
                if not second:
                    lower_pos[done : done + len(pos)], lower_lcp[done : done + len(pos)] = pos, lcp
                    done += len(pos)
        else:
            some = np.asarray(order[a:b])
            for second, pos, lcp in up.several(low, high, text[some].astype(np.int32), some, np.asarray(seed_lcp[a:b])):
                pos, lcp = pos[second == 0], lcp[second == 0]
                lower_pos[done : done + len(pos)], lower_lcp[done : done + len(pos)] = pos, lcp
                done += len(pos)
        up.queue.settle()
    del up, order, seed_lcp

    def lower(a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """L suffixes b to a, downwards, each with the common prefix with the one above."""
        for x in range(b, a, -STEP):
            y = max(a, x - STEP)
            above = np.append(lower_lcp[y + 1 : x], lower_lcp[x] if x < len(lower_lcp) else 0).astype(np.uint8)
            yield np.asarray(lower_pos[y:x])[::-1], above[::-1]

    down = _Pass(code, top, 1, depth, space, True)
    for low, high in reversed(buckets):
        a, b = int(lower_end[low] - count[2 * low]), int(lower_end[high - 1])
        if high - low == 1:
            for _, pos, lcp in down.one(top - 1 - low, lower(a, b)):
                yield pos, lcp
        else:
            found = list(lower(a, b))
            pos, lcp = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            symbol = top - 1 - text[pos.astype(np.int64)].astype(np.int32)
            for _, pos, lcp in down.several(top - high, top - low, symbol, pos, lcp.astype(np.uint8)):
                yield pos, lcp
        down.queue.settle()
