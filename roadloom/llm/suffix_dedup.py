"""Exact substring deduplication: removes every byte of a string of LENGTH bytes that also starts earlier.

Equal strings must meet in one shard. Each LENGTH-byte window is keyed by the least hash of the GRAM-byte strings in it, so equal
windows have equal keys wherever they stand; consecutive windows of one key form a piece. Pieces whose key stands alone in the
corpus cannot repeat and go no further (counted by key, after each task has counted its own). The bytes of the other pieces go to
shards by key, where suffixes are sorted by external induced sorting (induced_sort.py): neighbours that share LENGTH bytes are
one string, all of whose starts but the earliest are removed with the LENGTH bytes that follow. A shard is the concatenation of
its pieces, so a string is judged on the input and never crosses a document.

Equal pieces that one task meets are combined before they are shuffled, and again before they are sorted, as far as BUDGET bytes of them
are remembered; those that are not are settled by the sort. So copies of a hot group are one piece for each task. What differs under one
key is sorted by one task, through the disk, however much it is: the shard's text, its strings of names and its queue are in
files beyond the budget, which is small enough that a shard of the usual size spills and recurses.

Rows: a null text is empty; a null doc_id counts as the smallest; rows that repeat one doc_id and text are each judged as that
document, against other starts only; rows of one doc_id with other texts are judged apart (told apart by a 64-bit hash and the
length). Texts under LENGTH bytes lose nothing. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import U64, lean, mix, partitions, raw_text, steps, stored
from roadloom.llm.induced_sort import Counters, Space, induced

LENGTH = 100
#: Bytes hashed together; a window's key is the least of its LENGTH - GRAM + 1 hashes.
GRAM = 24
#: Bytes on one side of a window's least gram, at least: half of those that the gram leaves.
SIDE = (LENGTH - GRAM) // 2
#: Memory of one shard's queue, of its text and of pieces remembered; what exceeds it is sorted through the disk.
BUDGET = 12 << 20
#: Symbols sorted together in a shard. Equal keys stay together, so a longer stretch of one key is one (external) sort.
SHARD_SYMBOLS = 4 << 20
#: Windows in one piece at most (15 bits of a packed span); a longer stretch of one key is several pieces.
MOST_WINDOWS = 32_000
FIRST_ID = -(1 << 63)
#: Bytes of text hashed in one step: its arrays stay in a core's cache.
HASH_STEP = 1 << 16


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of data[i : i + GRAM] at each i."""
    x = data.astype(np.uint64)
    two = x[:-1] | (x[1:] << U64(8))
    four = two[:-2] | (two[2:] << U64(16))
    eight = four[:-4] | (four[4:] << U64(32))
    n = len(data) - GRAM + 1
    return mix(eight[:n] * U64(0x9E3779B97F4A7C15) + mix(eight[8 : 8 + n] * U64(0xC2B2AE3D27D4EB4F) + eight[16 : 16 + n]))


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each x[i : i + width]."""
    f, done, now = (np.minimum if least else np.maximum), 1, x
    while 2 * done <= width:
        now = f(now[:-done], now[done:])
        done *= 2
    return f(now[: len(x) - width + 1], now[width - done : width - done + len(x) - width + 1])


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows, a window may occur again inside) of all pieces of whole texts."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    if len(data) < LENGTH:
        return none
    width = LENGTH - GRAM + 1
    grams = _gram_hashes(data)
    keys = _slide(grams, width, True)
    valid = np.zeros(len(keys) + 1, np.int8)
    long_ = np.diff(offsets) >= LENGTH
    if not long_.any():
        return none
    begin, end = offsets[:-1][long_], offsets[1:][long_] - LENGTH + 1
    valid[begin] += 1
    np.add.at(valid, end, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    cut = np.zeros(len(keys), bool)
    cut[0] = True
    cut[1:] = (keys[1:] != keys[:-1]) | (valid[1:] != valid[:-1])
    cut[begin] = True
    at = np.flatnonzero(cut)
    size = np.diff(np.append(at, len(keys)))
    use = valid[at]
    at, size = at[use], size[use]
    if (size > MOST_WINDOWS).any():
        parts = -(-size // MOST_WINDOWS)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, size = np.repeat(at, parts) + step * MOST_WINDOWS, np.minimum(MOST_WINDOWS, np.repeat(size, parts) - step * MOST_WINDOWS)
    # a window that occurs twice in a piece spans two neighbours of equal hash among all windows' least grams; neighbours width
    # apart share no window, so the mark goes one window on, to the first that holds only the second
    wide = np.concatenate([np.zeros(width - 1, np.uint64), keys, np.zeros(width - 1, np.uint64)])
    least = np.flatnonzero(grams == _slide(wide, width, False))
    again = (grams[least[1:]] == grams[least[:-1]]) & (np.diff(least) <= width)
    mark = np.zeros(len(keys) + 1, np.int32)
    np.add.at(mark, np.clip(least[1:][again] - width + 1, 0, len(keys)), 1)
    np.add.at(mark, np.clip(least[:-1][again] + 2, 0, len(keys)), -1)
    inside = np.maximum.reduceat((np.cumsum(mark[:-1]) > 0).astype(np.int8), at) > 0 if len(at) else np.zeros(0, bool)
    return keys[at], at, size, inside


def _pack(lo: np.ndarray, n: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """47 bits of the first window, 15 of their number, one for a repeat inside."""
    return (lo << 16) | (n << 1) | inside.astype(np.int64)


def _unpack(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return span >> 16, (span >> 1) & 0x7FFF, (span & 1) > 0


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces: slot (what is counted), key (set where the piece is known to repeat), doc, ver, span (first window, windows, repeat inside)."""
    for batch in batches:
        docs, vers = batch.column("doc").to_numpy(), batch.column("ver").to_numpy()
        found = []
        for i, j, data, offsets in steps(batch.column("raw"), HASH_STEP):
            key, at, n, inside = pieces(data, offsets)
            row = np.searchsorted(offsets, at, side="right") - 1
            found.append((key, docs[i + row], vers[i + row], _pack(at - offsets[row], n, inside), inside))
        key, doc, ver, span, known = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0)] * 5
        if not len(key):
            continue
        _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        once = np.zeros(len(key), bool)
        once[first] = True
        sure = known | (count[inverse] > 1)
        # of a key that repeats here one row is counted under the key for other tasks' sake, the rest are dealt by place
        place = mix(doc.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + mix(ver.astype(np.uint64)) + span.astype(np.uint64))
        slot = np.where(once, key, mix(key + place)).view(np.int64)
        yield pa.record_batch({"slot": pa.array(slot), "key": pa.array(key.view(np.int64), mask=~sure), "doc": pa.array(doc), "ver": pa.array(ver), "span": pa.array(span)})


class _Seen:
    """Pieces that were met and the least place of each, as far as the budget goes."""

    def __init__(self, budget: int):
        self.budget, self.held, self.place = budget, 0, {}

    def late(self, piece: bytes, place: tuple[int, int]) -> bool:
        """Whether an equal piece stands at an earlier place that was met; else this place is kept."""
        known = self.place.get(piece)
        if known is not None and known < place:
            return True
        if known is None:
            self.held += len(piece) + 150
            if self.held > self.budget:
                self.place.clear()
                self.held = len(piece) + 150
        self.place[piece] = place
        return False


def _cut(budget: int):
    """Bytes of the pieces; a piece that equals an earlier one of this task is reported as all repeated (piece is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last = _Seen(budget), (None, None)
        for batch in batches:
            docs, vers = batch.column("doc").to_numpy(), batch.column("ver").to_numpy()
            spans = batch.column("spans")
            lists = spans.offsets.to_numpy()
            flat = spans.flatten()
            size = np.diff(lists)
            again = np.concatenate([[(docs[0], vers[0]) == last], (docs[1:] == docs[:-1]) & (vers[1:] == vers[:-1])]) if len(docs) else np.zeros(0, bool)
            last = (docs[-1], vers[-1]) if len(docs) else last
            row = np.repeat(np.arange(batch.num_rows), size)
            use = ~again[row]  # a repeated row has nothing new
            row = row[use]
            key = flat.field("key").to_numpy()[use]
            lo, n, inside = _unpack(flat.field("span").to_numpy()[use])
            doc, ver = docs[row], vers[row]
            texts = batch.column("raw").to_pylist()
            out: list[bytes | None] = [None] * len(key)
            order = np.lexsort((lo, doc))
            for x, r, d, a, m in zip(order.tolist(), row[order].tolist(), doc[order].tolist(), lo[order].tolist(), n[order].tolist(), strict=True):
                piece = texts[r][a : a + m + LENGTH - 1]
                if not seen.late(piece, (d, a)):
                    out[x] = piece
            whole = np.array([x is not None for x in out], bool)
            yield pa.record_batch({c: pa.array(v[whole]) for c, v in (("key", key), ("doc", doc), ("ver", ver), ("lo", lo), ("n", n), ("inside", inside))} | {"piece": pa.array([x for x in out if x is not None], pa.binary())})
            late = order[~whole[order]]
            if len(late):  # neighbouring pieces make one stretch of repeated windows
                r, a, m = row[late], lo[late], n[late]
                sort = np.lexsort((a, r))
                r, a, m = r[sort], a[sort], m[sort]
                cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] != a[:-1] + m[:-1])]))
                none = len(cut)
                yield pa.record_batch(
                    {
                        "key": pa.nulls(none, pa.int64()),
                        "doc": pa.array(docs[r[cut]]),
                        "ver": pa.array(vers[r[cut]]),
                        "lo": pa.array(a[cut]),
                        "n": pa.array(np.add.reduceat(m, cut)),
                        "inside": pa.nulls(none, pa.bool_()),
                        "piece": pa.nulls(none, pa.binary()),
                    }
                )

    return run


class Shard:
    """Pieces of whole keys: the bytes of different ones, in a file beyond the budget, and the places of all."""

    def __init__(self, budget: int):
        self.budget, self.size, self.wide = budget, 0, False
        self.rows = {c: array("q") for c in ("key", "doc", "ver", "lo", "n")}
        self.inside, self.offsets = array("b"), array("q", [0])
        self.body = tempfile.SpooledTemporaryFile(max_size=budget)
        self.at: dict[bytes, int] = {}
        self.held = 0
        self.late: list[tuple[int, int, int, int]] = []

    def add(self, batch: pa.RecordBatch) -> None:
        columns = [batch.column(c).to_pylist() for c in ("key", "doc", "ver", "lo", "n", "inside", "piece")]
        rows, at = self.rows, self.at
        for key, doc, ver, lo, n, inside, piece in zip(*columns, strict=True):
            known = at.get(piece)
            if known is not None:
                was = rows["doc"][known], rows["lo"][known]
                if (doc, lo) < was:  # the earliest stays
                    self.late.append((rows["doc"][known], rows["ver"][known], rows["lo"][known], rows["n"][known]))
                    rows["doc"][known], rows["ver"][known], rows["lo"][known] = doc, ver, lo
                    continue
                if (doc, lo) > was:
                    self.late.append((doc, ver, lo, n))
                    continue
                if ver == rows["ver"][known]:
                    continue
            self.held += len(piece) + 150
            if self.held > self.budget:
                at.clear()
                self.held = len(piece) + 150
            at[piece] = len(rows["key"])
            for c, value in zip(rows, (key, doc, ver, lo, n), strict=True):
                rows[c].append(value)
            self.inside.append(inside)
            self.body.write(piece)
            self.size += len(piece) + 1
            self.offsets.append(self.offsets[-1] + len(piece))
            self.wide = self.wide or b"\xff" in piece

    def _read(self, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, row after the last, bytes) of runs of pieces, in order."""
        self.body.seek(0)
        a, n = 0, len(offsets) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 20), side="right")) - 1)
            yield a, b, np.frombuffer(self.body.read(int(offsets[b] - offsets[a])), np.uint8)
            a = b

    def _may_repeat(self, key: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether a window of a piece can be in another one, for pieces that hold their least gram once.

        A window holds that gram and SIDE bytes at least on one side of it; so pieces that share a window share one of the two.
        """
        sides = np.zeros((2, len(key)), np.uint64)
        for a, b, data in self._read(offsets):
            if len(data) < GRAM:
                continue
            grams = _gram_hashes(data)
            begin = offsets[a : b + 1] - offsets[a]
            row = np.repeat(np.arange(b - a), np.diff(begin))[: len(grams)]
            at = np.flatnonzero(grams == key[a:b].view(np.uint64)[row])
            at = at[at + GRAM <= begin[row[at] + 1]]
            row, first = np.unique(row[at], return_index=True)
            at = at[first]
            right, left = at + GRAM + SIDE <= begin[row + 1], at - SIDE >= begin[row]
            mixed = mix(grams[at] ^ key[a:b].view(np.uint64)[row])
            for side, there, steps_ in ((0, right, (GRAM, SIDE)), (1, left, (-SIDE, GRAM - SIDE))):
                h = mixed[there] + U64(side)
                for step in steps_:
                    h = mix(h * U64(0x9E3779B97F4A7C15) + grams[at[there] + step])
                sides[side, a + row[there]] = h
        out = np.zeros(len(key), bool)
        for side in sides:
            _, group, count = np.unique(side, return_inverse=True, return_counts=True)
            out |= (count[group] > 1) & (side != 0)
        return out

    def repeated(self, counters: Counters | None = None) -> Iterator[np.ndarray]:
        """Rows (doc, ver, first window, windows) of all windows that start earlier elsewhere."""
        if self.late:
            yield np.array(self.late, np.int64).T
        key, doc, ver, lo = (np.frombuffer(self.rows[c], np.int64) for c in ("key", "doc", "ver", "lo"))
        if not len(key):
            return
        offsets = np.frombuffer(self.offsets, np.int64)
        # only keys with several pieces and pieces that may repeat inside need sorting
        _, group, count = np.unique(key, return_inverse=True, return_counts=True)
        inside = np.frombuffer(self.inside, np.int8) > 0
        use = inside | ((count[group] > 1) & self._may_repeat(key, offsets))
        size = np.diff(offsets)
        begin = np.concatenate([[0], np.cumsum(size[use] + 1)])
        space = Space(self.budget, counters)
        # a wider alphabet where the text isn't UTF-8; what ends a piece is then below all bytes
        text = space.array(int(begin[-1]), np.uint16 if self.wide else np.uint8)
        place = np.zeros(len(key), np.int64)
        place[use] = begin[:-1]
        for a, b, data in self._read(offsets):
            to = np.repeat(place[a:b] - offsets[a:b] + offsets[a], size[a:b]) + np.arange(len(data))
            taken = np.repeat(use[a:b], size[a:b])
            text[to[taken]] = data[taken] if not self.wide else data[taken].astype(np.uint16) + 1
        text[begin[1:] - 1] = 0 if self.wide else 255
        self.body.close()
        if len(begin) > 1:
            yield from repeated_windows(text, begin, doc[use], ver[use], lo[use], self.budget, counters)


def repeated_windows(text: np.ndarray, begin: np.ndarray, doc: np.ndarray, ver: np.ndarray, lo: np.ndarray, budget: int, counters: Counters | None = None) -> Iterator[np.ndarray]:
    """Rows (doc, ver, first window, windows) of all windows that start earlier elsewhere in the pieces of a text, which begin at ``begin``."""
    late = Space(budget, counters).array(len(text), bool)
    late[:] = False
    lead = np.zeros(0, np.int64)  # the earliest so far of the strings equal to the last one seen
    for pos, lcp in induced(text, LENGTH, budget, counters):
        pos, same = np.concatenate([lead, pos.astype(np.int64)]), np.concatenate([np.zeros(len(lead), bool), lcp >= LENGTH])
        member = same.copy()
        member[:-1] |= same[1:]  # the first of a group, too
        member[-1] = True  # and one that may go on
        group = np.cumsum(~same)[member]
        pos = pos[member]
        row = np.searchsorted(begin, pos, side="right") - 1
        whole = pos + LENGTH < begin[row + 1]  # no end of a piece among its bytes; alike for all of a group
        pos, group, row = pos[whole], group[whole], row[whole]
        lead = np.zeros(0, np.int64)
        if not len(pos):
            continue
        start, d = lo[row] + pos - begin[row], doc[row]
        order = np.lexsort((start, d, group))
        g = group[order]
        head = np.concatenate([[True], g[1:] != g[:-1]])
        first = order[np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))]
        late[pos[order[(d[order] != d[first]) | (start[order] != start[first])]]] = True
        if whole[-1]:
            lead = pos[first[-1:]]
    for a in range(0, len(doc), 1 << 16):
        b = min(len(doc), a + (1 << 16))
        marked = np.flatnonzero(late[begin[a] : begin[b]]) + begin[a]
        if not len(marked):
            continue
        row = np.searchsorted(begin, marked, side="right") - 1
        start = lo[row] + marked - begin[row]
        cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]))
        yield np.stack([doc[row[cut]], ver[row[cut]], start[cut], np.diff(np.append(cut, len(row)))])


def _sort_shards(budget: int, symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = Shard(budget), None

        def ready() -> Iterator[pa.RecordBatch]:
            for rows in shard.repeated():
                yield pa.record_batch({c: pa.array(v) for c, v in zip(("doc", "ver", "lo", "n"), rows, strict=True)})

        for batch in batches:
            null = batch.column("piece").is_null()
            if null.true_count:
                yield batch.filter(null).select(["doc", "ver", "lo", "n"])
                batch = batch.filter(pc.invert(null))
            while batch.num_rows:
                # rows come sorted by key: a sort ends only between keys
                key = batch.column("key").to_numpy()
                if shard.size >= symbols and key[0] != last:
                    yield from ready()
                    shard = Shard(budget)
                lengths = np.cumsum(np.diff(np.frombuffer(batch.column("piece").buffers()[1], np.int32)[batch.column("piece").offset :][: batch.num_rows + 1]).astype(np.int64) + 1)
                upto = int(np.searchsorted(lengths, max(0, symbols - shard.size))) + 1
                while upto < len(key) and key[upto] == key[upto - 1]:
                    upto += 1
                upto = min(upto, len(key))
                shard.add(batch.slice(0, upto))
                last = key[upto - 1]
                batch = batch.slice(upto)
        if len(shard.rows["key"]) or shard.late:
            yield from ready()

    return run


def _finish(texts_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, digest, kept = [], [], [], [], []
            windows = batch.column("windows")
            flat, lists = windows.flatten(), windows.offsets.to_numpy()
            lists = lists - lists[0]
            lo_all, n_all = flat.field("lo").to_numpy(), flat.field("n").to_numpy()
            null = windows.is_null().to_pylist()
            for r, raw in enumerate(batch.column("raw").to_pylist()):
                text = raw or b""
                size.append(len(text))
                n_removed = n_spans = 0
                if not null[r] and lists[r + 1] > lists[r]:
                    lo, n = lo_all[lists[r] : lists[r + 1]], n_all[lists[r] : lists[r + 1]]
                    edge = np.zeros(len(text) + 1, np.int32)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, lo + n + LENGTH - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    text = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    n_removed, n_spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                removed.append(n_removed)
                spans.append(n_spans)
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode("utf-8", "ignore") if raw is not None and texts_too else None)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "row": batch.column("row"),
                    "n_bytes": pa.array(size, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "n_spans": pa.array(spans, pa.int64()),
                    "kept_sha256": pa.array(digest, pa.string()),
                    "kept_text": pa.array(kept, pa.string()),
                }
            )

    return run


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, budget: int = BUDGET, symbols: int = SHARD_SYMBOLS, texts_too: bool = True) -> DataFrame:
    """(doc_id, row, n_bytes, n_removed, n_spans, kept_sha256, kept_text) for every row of docs(doc_id, text).

    kept_text (null for all without texts_too): the remaining bytes as text, without what is left of a character that lost a byte, null for null; row: a struct of the columns named in carry (null for none).
    """
    spark = docs.sparkSession
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID))
    # texts are told apart by a hash, too, where an id is not enough
    shared_id = not docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    ver = F.xxhash64(raw_text(), F.length(raw_text())) if shared_id else F.lit(0).cast("long")
    base = docs.select(row.alias("row"), doc.alias("doc"), ver.alias("ver"), F.col("text").cast("binary").alias("raw"))
    kind = base.schema["row"].dataType.simpleString()
    texts = base.select("doc", "ver", F.coalesce("raw", F.lit(b"")).alias("raw"))
    keys = ["doc", "ver"] if shared_id else ["doc"]
    found = texts.mapInArrow(lean(_find), "slot long, key long, doc long, ver long, span long")
    number = "count(*) over (partition by slot)"
    repeated = found.withColumn("c", F.expr(number)).where("c > 1 or key is not null").select(F.coalesce("key", "slot").alias("key"), "doc", "ver", "span")
    wanted = repeated.groupBy(*keys).agg(F.collect_set(F.struct("key", "span")).alias("spans"))
    # both joins take the same columns of the texts, so that these are shuffled once
    cut = wanted.join(base, keys).select("doc", "ver", "raw", "row", "spans")
    out = "key long, doc long, ver long, lo long, n long, inside boolean, piece binary"
    cut = cut.mapInArrow(lean(_cut(budget)), out)
    route = F.when(F.col("piece").isNull(), F.xxhash64("doc", "lo")).otherwise(F.col("key"))
    shards = cut.withColumn("route", route).repartition(partitions(spark), "route").sortWithinPartitions("route").drop("route")
    late = shards.mapInArrow(lean(_sort_shards(budget, symbols)), "doc long, ver long, lo long, n long")
    windows = late.groupBy(*keys).agg(F.collect_set(F.struct("lo", "n")).alias("windows"))
    whole = base.join(windows, keys, "left").select(F.nullif("doc", F.lit(FIRST_ID)).alias("doc_id"), "row", "raw", "windows")
    kind = f"doc_id long, row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return stored(whole.mapInArrow(lean(_finish(texts_too)), kind), "cut")
