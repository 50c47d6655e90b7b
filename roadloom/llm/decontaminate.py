"""Benchmark decontamination by a distributed positional inverted index over the training texts.

The index holds every word of the training texts, whatever the benchmark asks. It is cut by document into shards of about SHARD_BYTES of
text, so a frequent word or a hot source never gathers in one task: for each of its words a shard stores the ascending list of
token positions. It is written once to the shared folder and searched with any number of blocks of test items.

A phrase is looked up from its rarest word (by the whole corpus): that word's positions, shifted to the phrase's start, are
intersected with the shifted list of each next rarer word. All phrases of a block take each step together, as one search of
(word, position) keys in the shard's sorted ones. Proximity matches are found from the rarest word, too: stretches of window + slop
words that hold all the words of a window, in any order.

Test items reach executors as arrays of word numbers, in blocks of at most BLOCK_WORDS words (some 35 MB), each one pass over the index;
an item longer than a block is split between windows. So what is sent is bounded however many items there are.

Rows: a null text has no words; items without words or with a null id match nothing; an item shorter than a window is one
window; rows that repeat an item id are one item with the windows of all. Repeated document rows are reported each, a null doc_id
is kept. Extra columns are ignored; empty tables give an empty result or clean documents. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import LOWER, NOT_ALNUM, forget, lean, raw_text, steps, stored, word_hashes, word_spans

WINDOW = 10
#: Words by which a stretch may be longer than a window in a proximity match.
SLOP = 5
SHARD_BYTES = 8 << 20
#: Words of test items that one pass takes.
BLOCK_WORDS = 500_000
#: Places that one step of a search holds.
PLACES = 1 << 20


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's first word."""
    low = LOWER[data]
    starts, stops, first = word_spans(low, offsets, NOT_ALNUM)
    return (word_hashes(low, starts, stops) if len(low) else np.zeros(0, np.uint64)), first


def item_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return _tokens(data, np.array([0, len(data)]))[0] if len(data) else np.zeros(0, np.uint64)


class Phrases:
    """Windows of test items as numbers of words; equal windows are one phrase of several items.

    vocabulary: sorted hashes; terms: a row for each phrase, -1 after its last word; owners of phrase p: the items
    owner[owned[p] : owned[p + 1]], numbers in names.
    """

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        rows, of = [], []
        for name, words in items:
            if not len(words):
                continue
            at = np.searchsorted(self.vocabulary, words).astype(np.int32)
            if len(at) < window:
                at = np.concatenate([at, np.full(window - len(at), -1, np.int32)])
            rows.append(np.lib.stride_tricks.sliding_window_view(at, window))
            of.append(np.full(len(rows[-1]), number[name], np.int64))
        table = np.concatenate(rows) if rows else np.zeros((0, window), np.int32)
        self.terms, which = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
        pairs = np.unique(which.ravel() * max(1, len(self.names)) + (np.concatenate(of) if of else np.zeros(0, np.int64)))
        self.owner = pairs % max(1, len(self.names))
        self.owned = np.searchsorted(pairs // max(1, len(self.names)), np.arange(len(self.terms) + 1))
        self.length = (self.terms >= 0).sum(axis=1)
        self.by_rarity = np.tile(np.arange(window, dtype=np.int8), (len(self.terms), 1))

    def rank(self, counts: np.ndarray) -> None:
        """Orders each phrase's words by their occurrences in the corpus, rarest first."""
        n = np.where(self.terms >= 0, counts[self.terms] if len(counts) else 0, np.iinfo(np.int64).max)
        self.by_rarity = np.argsort(n, axis=1, kind="stable").astype(np.int8)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = (TaskContext.get().partitionId() << 32) - 1
    for batch in batches:
        for i, j, data, offsets in steps(batch.column("raw"), SHARD_BYTES):
            found, counts = [], []
            # words are found in smaller steps; positions run through the shard
            for _, _, part, at in steps(pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])):
                words, begin = _tokens(part, at)
                found.append(words)
                counts.append(np.diff(begin))
            words = np.concatenate(found)
            first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            order = np.argsort(words, kind="stable")
            words = words[order]
            head = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
            shard += 1
            yield pa.record_batch(
                {
                    "shard": pa.array([shard]),
                    "doc_ids": pa.array([batch.column("doc_id").slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                    "first": pa.array([first.astype(np.int64).tobytes()], pa.binary()),
                    "terms": pa.array([words[head].tobytes()], pa.binary()),
                    "heads": pa.array([np.append(head, len(words)).astype(np.int32).tobytes()], pa.binary()),
                    "positions": pa.array([order.astype(np.int32).tobytes()], pa.binary()),
                }
            )


_INDEX = "shard long, doc_ids array<long>, first binary, terms binary, heads binary, positions binary"


def build_index(docs: DataFrame) -> DataFrame:
    """A stored index of docs(doc_id, text): a row for each shard with the positions of all its words."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("raw"))
    return stored(base.mapInArrow(lean(_build), _INDEX), "index", SHARD_BYTES)


def _array(batch: pa.RecordBatch, column: str, row: int, kind) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_buffer(), kind)


def _places(batch: pa.RecordBatch, row: int, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lists of the vocabulary's words begin and end among a shard's positions."""
    terms, heads = _array(batch, "terms", row, np.uint64), _array(batch, "heads", row, np.int32)
    if not len(terms) or not len(vocabulary):
        return np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
    there = terms[at] == vocabulary
    return np.where(there, heads[at], 0).astype(np.int64), np.where(there, heads[at + 1], 0).astype(np.int64)


def _counts(vocabulary_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                begin, end = _places(batch, r, vocabulary_of.value)
                used = np.flatnonzero(end > begin)
                yield pa.record_batch({"term": pa.array(used.astype(np.int32)), "n": pa.array((end - begin)[used])})

    return run


def document_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each word of the vocabulary in the whole corpus; as many numbers as a block has words."""
    out = np.zeros(len(vocabulary), np.int64)
    told = index.sparkSession.sparkContext.broadcast(vocabulary)
    for r in index.select("terms", "heads").mapInArrow(lean(_counts(told)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.term] = r.n
    told.unpersist()
    return out


class Postings:
    """What one shard has of a block's words: (word, position) keys in ascending order."""

    def __init__(self, batch: pa.RecordBatch, row: int, vocabulary: np.ndarray):
        begin, end = _places(batch, row, vocabulary)
        self.size = end - begin
        self.end = np.cumsum(self.size)
        positions = _array(batch, "positions", row, np.int32)
        word = np.repeat(np.arange(len(vocabulary)), self.size)
        self.position = positions[np.arange(len(word)) - (self.end - self.size)[word] + begin[word]].astype(np.int64)
        self.keys = (word << 32) | self.position
        self.first = _array(batch, "first", row, np.int64)

    def starts(self, phrases: Phrases, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, position of its rarest word), at most PLACES or one phrase's at a time."""
        rare = phrases.terms[some, phrases.by_rarity[some, 0]]
        total = np.cumsum(self.size[rare])
        a = 0
        while a < len(some):
            done = total[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(total, done + PLACES, side="right")))
            size = self.size[rare[a:b]]
            which = np.repeat(np.arange(a, b), size)
            stop = np.cumsum(size)
            place = np.arange(len(which)) - np.repeat(stop - size, size) + np.repeat(self.end[rare[a:b]] - size, size)
            yield some[which], self.position[place]
            a = b

    def _next(self, word: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Key of the word's first occurrence from a position on (of a later word, if it has none)."""
        at = np.searchsorted(self.keys, (word.astype(np.int64) << 32) | position)
        return np.where(at < len(self.keys), self.keys[np.minimum(at, len(self.keys) - 1)], np.iinfo(np.int64).max)

    def present(self, phrases: Phrases) -> np.ndarray:
        """Phrases all of whose words the shard has."""
        some = np.flatnonzero(self.size[phrases.terms[np.arange(len(phrases.terms)), phrases.by_rarity[:, 0]]] > 0) if len(phrases.terms) else np.zeros(0, np.int64)
        terms = phrases.terms[some]
        return some[((self.size[terms] > 0) | (terms < 0)).all(axis=1)]

    def exact(self, phrases: Phrases, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of all places where a phrase's words follow one another within a document."""
        found = []
        for phrase, place in self.starts(phrases, some):
            start = place - phrases.by_rarity[phrase, 0]
            for k in range(1, phrases.terms.shape[1]):
                offset = phrases.by_rarity[phrase, k].astype(np.int64)
                word = phrases.terms[phrase, offset]
                want = (word.astype(np.int64) << 32) | (start + offset)
                ok = (word < 0) | ((start >= 0) & (self._next(word, start + offset) == want))
                phrase, start = phrase[ok], start[ok]
            doc = np.searchsorted(self.first, start, side="right") - 1
            ok = (start >= 0) & (start + phrases.length[phrase] <= self.first[np.minimum(doc + 1, len(self.first) - 1)])
            found.append((phrase[ok], start[ok]))
        return _joined(found)

    def near(self, phrases: Phrases, some: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of all stretches of its length + slop words, or fewer at a document's end, that hold all its words."""
        found = []
        for phrase, place in self.starts(phrases, some):
            doc = np.searchsorted(self.first, place, side="right") - 1
            span = phrases.length[phrase] + slop
            for k in range(1, phrases.terms.shape[1]):
                # an occurrence that could be in one stretch with the rarest word
                word = phrases.terms[phrase, phrases.by_rarity[phrase, k]]
                low = np.maximum(place - span + 1, self.first[doc])
                high = np.minimum(place + span, self.first[doc + 1])
                ok = (word < 0) | (self._next(word, low) < ((word.astype(np.int64) << 32) | high))
                phrase, place, doc, span = phrase[ok], place[ok], doc[ok], span[ok]
            if not len(phrase):
                continue
            widest = int(span.max())
            start = (place[:, None] - np.arange(widest)[None, :]).ravel()
            phrase, doc, span = (np.repeat(x, widest) for x in (phrase, doc, span))
            ok = (start >= self.first[doc]) & (start > np.repeat(place, widest) - span)
            pair = np.unique((phrase[ok] << 32) | start[ok])
            phrase, start = pair >> 32, pair & 0xFFFFFFFF
            doc = np.searchsorted(self.first, start, side="right") - 1
            stop = np.minimum(start + phrases.length[phrase] + slop, self.first[doc + 1])
            for k in range(phrases.terms.shape[1]):
                word = phrases.terms[phrase, phrases.by_rarity[phrase, k]]
                ok = (word < 0) | (self._next(word, start) < ((word.astype(np.int64) << 32) | stop))
                phrase, start, stop = phrase[ok], start[ok], stop[ok]
            found.append((phrase, start))
        return _joined(found)


def _joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([f[x] for f in found]) if found else np.zeros(0, np.int64) for x in (0, 1))


def _spans(start: np.ndarray, stop: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """For each document the first and last (exclusive) word, counted from its own first, of each maximal run of hit words."""
    edge = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, stop, -1)
    hit = np.cumsum(edge[:-1]) > 0
    border = np.zeros(len(hit) + 1, bool)
    border[first] = True  # a run ends with its document
    begins = np.flatnonzero(hit & (~np.concatenate([[False], hit[:-1]]) | border[:-1])) if len(hit) else np.zeros(0, np.int64)
    ends = np.flatnonzero(hit & (~np.append(hit[1:], False) | border[1:])) + 1 if len(hit) else begins
    doc = np.searchsorted(first, begins, side="right") - 1
    flat = np.stack([begins - first[doc], ends - first[doc]], axis=1).ravel()
    return pa.ListArray.from_arrays(pa.array((2 * np.searchsorted(begins, first)).astype(np.int32)), pa.array(flat, pa.int64()))


def _owners(phrase: np.ndarray, start: np.ndarray, first: np.ndarray, phrases: Phrases) -> pa.ListArray:
    """For each document the numbers of the items whose phrases start in it."""
    n_items, n_docs = max(1, len(phrases.names)), len(first) - 1
    doc = np.searchsorted(first, start, side="right") - 1
    pair = np.unique(doc * max(1, len(phrases.terms)) + phrase)
    doc, phrase = pair // max(1, len(phrases.terms)), pair % max(1, len(phrases.terms))
    size = phrases.owned[phrase + 1] - phrases.owned[phrase]
    stop = np.cumsum(size)
    at = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size, size) + np.repeat(phrases.owned[phrase], size)
    both = np.unique(np.repeat(doc, size) * n_items + phrases.owner[at])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(both // n_items, np.arange(n_docs + 1)).astype(np.int32)), pa.array(both % n_items, pa.int64()))


def _search(phrases_of, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = phrases_of.value
        for batch in batches:
            for r in range(batch.num_rows):
                lists = Postings(batch, r, phrases.vocabulary)
                first, n_docs = lists.first, len(lists.first) - 1
                some = lists.present(phrases)
                phrase, start = lists.exact(phrases, some)
                near, near_start = lists.near(phrases, some, slop)
                near_doc = np.searchsorted(first, near_start, side="right") - 1
                yield pa.record_batch(
                    {
                        "shard": pa.array(np.full(n_docs, batch.column("shard")[r].as_py(), np.int64)),
                        "place": pa.array(np.arange(n_docs)),
                        "doc_id": pa.array(batch.column("doc_ids")[r].as_py(), pa.int64()),
                        "n_words": pa.array(np.diff(first)),
                        "spans": _spans(start, start + phrases.length[phrase], first),
                        "items": _owners(phrase, start, first, phrases),
                        "near_spans": _spans(near_start, np.minimum(near_start + phrases.length[near] + slop, first[near_doc + 1]), first),
                        "near_items": _owners(near, near_start, first, phrases),
                    }
                )

    return run


def _covered(lists: list[list[int]]) -> int:
    """Words in the union of runs."""
    total = reached = 0
    for a, b in sorted(s for spans in lists for s in zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, b - max(a, reached))
        reached = max(reached, b)
    return total


_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long, n_near_items long, items array<string>, near_items array<string>"


def _merge(names_of):
    """One row per document from the rows of all blocks of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = names_of.value
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_hit", "n_items", "items_sha256", "contaminated", "n_near", "n_near_items", "items", "near_items")}
            for found in batch.column("found").to_pylist():
                ids, near = (sorted({known[f["block"]][i] for f in found for i in f[c]}) for c in ("items", "near_items"))
                n_hit = _covered([f["spans"] for f in found])
                row = (n_hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest() if ids else nothing, n_hit > 0, _covered([f["near_spans"] for f in found]), len(near), ids, near)
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            kinds = {"items_sha256": pa.string(), "contaminated": pa.bool_(), "items": pa.list_(pa.string()), "near_items": pa.list_(pa.string())}
            yield pa.record_batch({c: batch.column(c) for c in ("doc_id", "n_words")} | {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    return run


def _blocks(benchmark: DataFrame, window: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Items in blocks of about BLOCK_WORDS words; longer ones in parts that overlap by a window less one word."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    for r in rows.toLocalIterator():
        words = item_words(r.text)
        for at in range(0, max(1, len(words) - window + 1), BLOCK_WORDS):
            part = words[at : at + BLOCK_WORDS + window - 1]
            if size and size + len(part) > BLOCK_WORDS:
                yield block
                block, size = [], 0
            block.append((r.item_id, part))
            size += len(part)
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """A row for every row of docs(doc_id, text), against benchmark(item_id, text).

    doc_id, n_words; n_hit, n_items, items_sha256, contaminated, items: exact phrases of ``window`` words; n_near, n_near_items, near_items:
    the words inside stretches of window + slop words that hold all the words of a window in any order, and the items.
    """
    sc = docs.sparkSession.sparkContext
    index = build_index(docs)
    parts, names = [], []
    kind = "shard long, place long, doc_id long, n_words long, spans array<long>, items array<long>, near_spans array<long>, near_items array<long>"
    for b, items in enumerate(_blocks(benchmark, window)):
        phrases = Phrases(items, window)
        phrases.rank(document_counts(index, phrases.vocabulary))
        names.append(phrases.names)
        parts.append(index.mapInArrow(lean(_search(sc.broadcast(phrases), slop)), kind).withColumn("block", F.lit(b)))
    known = sc.broadcast(names)
    found = F.struct("block", "spans", "items", "near_spans", "near_items")
    if len(parts) == 1:
        rows = parts[0].select("doc_id", "n_words", F.array(found).alias("found"))
    else:
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows = rows.groupBy("shard", "place").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list(found).alias("found"))
        rows = rows.select("doc_id", "n_words", "found")
    out = stored(rows.mapInArrow(lean(_merge(known)), _OUT), "hits")
    forget(index)
    return out
