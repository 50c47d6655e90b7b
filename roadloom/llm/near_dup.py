"""MinHash near-duplicate classes through a multi-index Hamming join over b-bit signatures.

A document's word shingles get CHUNKS * SYMBOLS minimum hashes of 16 bits. Two signatures that differ in fewer than
CHUNKS * (ERRORS + 1) symbols agree, in one chunk at least, on all but ERRORS symbols (pigeonhole); so each chunk is indexed
once for every choice of ERRORS symbols to leave out, and equal keys give every pair under that distance. A pair at the
similarity bound stays below it in the chance sense: with 9 chunks of 5 symbols, one error each, all chunks fail with
probability 9e-8 at 0.85, 6e-6 at 0.8, and far less above. Pairs are then confirmed on the full shingle sets.

Equal sets form one class first. Within a bucket, members are compared with the bucket's first member; whoever is in the same
component already needs no further comparison. The rest are compared across components only, under an exact bound: each set
has a parity bitmap (bit b: whether an odd number of its shingles hash to b), and two bitmaps never differ in more bits than
their sets differ in shingles. So only pairs that are links, or nearly, leave a bucket, not all pairs of a group.

Measured, the chance of a missed link is that of the formula: see test_recall_of_planted_links.

Rows: a null text is empty; a text without words has an empty set and is linked with nothing. Rows of one doc_id are one
document for links. A null doc_id keeps its row: its text links nothing, component_id is null, kept is false unless an
equal set has an id. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import LOWER, SPACES, U64, components, forget, lean, mix, partitions, raw_text, steps, stored, word_hashes, word_spans

CHUNKS, SYMBOLS, ERRORS = 9, 5, 1
WIDTH = CHUNKS * SYMBOLS
#: Bits of a parity bitmap for each shingle, rounded up to a power of two.
BITS_EACH = 4
#: Ids that may be sent to all executors (16 MB); beyond it the join is shuffled.
BROADCAST_IDS = 2_000_000
#: Members of a bucket that one task compares; larger buckets are cut into pairs of blocks.
BLOCK = 1024

_rng = np.random.default_rng(77)
_FLIP = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * U64(2) + U64(1)
_ORDER = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * U64(2) + U64(1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and each document's first index; a shorter text is one shingle of all its words."""
    low = LOWER[data]
    starts, stops, first = word_spans(low, offsets, SPACES)
    words = word_hashes(low, starts, stops) if len(low) else np.zeros(0, np.uint64)
    n_words = np.diff(first)
    if len(words) >= k:
        all_k = words[: len(words) - k + 1] * _ORDER[0]
        for j in range(1, k):
            all_k = all_k + words[j : len(words) - k + 1 + j] * _ORDER[j]
        all_k = mix(all_k)
    else:
        all_k = np.zeros(0, np.uint64)
    counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    begin = np.concatenate([[0], np.cumsum(counts)])
    take = np.arange(begin[-1]) - np.repeat(begin[:-1], counts) + np.repeat(first[:-1], counts)
    out = np.zeros(len(take), np.uint64)
    fits = np.repeat(n_words >= k, counts)
    out[fits] = all_k[take[fits]]
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):
        whole = words[first[d] : first[d + 1]]
        out[begin[d]] = mix((whole * _ORDER[: len(whole)]).sum(keepdims=True) + U64(len(whole)))[0]
    return out, begin


def signatures(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """WIDTH symbols of 16 bits for every document that has shingles, zeros for the others."""
    out = np.zeros((len(begin) - 1, WIDTH), np.uint16)
    full = np.flatnonzero(np.diff(begin) > 0)
    if len(full):
        at = begin[:-1][full]
        for f in range(WIDTH):
            out[full, f] = mix(np.minimum.reduceat((hashes ^ _FLIP[f]) * _TIMES[f], at)).astype(np.uint16)
    return out


def parity(shingles: np.ndarray) -> bytes:
    """Bitmap of the parities of shingles mod its length; halves XORed give the bitmap of half the length."""
    size = max(64, 1 << (BITS_EACH * len(shingles) - 1).bit_length()) if len(shingles) else 64
    odd = np.bincount((shingles & U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bitmaps: list[np.ndarray], words: int) -> np.ndarray:
    """Bitmaps of at least so many 64-bit words, folded to that many."""
    return np.stack([np.bitwise_xor.reduce(b.reshape(-1, words), axis=0) for b in bitmaps])


def _words(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _may_link(differ: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in at least so many shingles can have the similarity."""
    return (100 + percent) * differ <= (100 - percent) * (n_a + n_b)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in steps(batch.column("raw")):
                hashes, begin = shingle_hashes(data, offsets, k)
                sets = [np.unique(hashes[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
                sig = signatures(hashes, begin)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(i, j - i),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "digest": pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()),
                        "sig": pa.array([s.tobytes() for s in sig], pa.binary()),
                        "bits": pa.array([parity(s) for s in sets], pa.binary()),
                    }
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in steps(batch.column("raw")):
                hashes, begin = shingle_hashes(data, offsets, k)
                sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.record_batch({"node": batch.column("doc_id").slice(i, j - i), "shingles": pa.array(sets, pa.binary())})

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), WIDTH)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key for each chunk and each choice of symbols left out."""
    for batch in batches:
        sig = _matrix(batch.column("sig")).astype(np.uint64)
        nodes = batch.column("node")
        for c in range(CHUNKS):
            part = sig[:, c * SYMBOLS : (c + 1) * SYMBOLS]
            for out in range(SYMBOLS):
                key = np.full(len(part), mix(_ORDER[8:9] + U64(c * SYMBOLS + out))[0])
                for s in range(SYMBOLS):
                    if s != out:
                        key = mix(key ^ (part[:, s] + U64(1 << 20)) * _ORDER[9 + s])
                yield pa.record_batch({"key": pa.array(key.view(np.int64)), "node": nodes})


def _close(percent: int):
    """Keeps pairs whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = []
            for x, y in zip(_words(batch.column("bits_a")), _words(batch.column("bits_b")), strict=True):
                w = min(len(x), len(y))
                x, y = _folded([x], w)[0], _folded([y], w)[0]
                differ.append(int(np.bitwise_count(x ^ y).sum()))
            can = _may_link(np.array(differ, np.int64), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(can))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _across(percent: int):
    """Pairs of different components in a bucket whose bitmaps allow a link; rows come sorted by group."""

    def pairs(rows: dict) -> tuple[np.ndarray, np.ndarray]:
        found_a, found_b = [], []
        n, comp, node, bits, block = rows["n"], rows["label"], rows["node"], rows["bits"], rows["block"]
        if (comp == comp[0]).all():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        same = rows["lo"][0] == rows["hi"][0]
        words = np.array([len(b) for b in bits])
        for w in np.unique(words):  # the shorter bitmap of a pair sets the length
            there = np.flatnonzero(words >= w)
            table = _folded([bits[x] for x in there], int(w))
            for x in np.flatnonzero(words[there] == w):
                i = there[x]
                y = np.flatnonzero((comp[there] != comp[i]) & ((words[there] > w) | (there > i)) & (True if same else block[there] != block[i]))
                j = there[y]
                fit = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                y, j = y[fit], j[fit]
                if not len(j):
                    continue
                fit = _may_link(np.bitwise_count(table[y] ^ table[x]).sum(axis=1, dtype=np.int64), n[i], n[j], percent)
                found_a.append(np.minimum(node[i], node[j[fit]]))
                found_b.append(np.maximum(node[i], node[j[fit]]))
        if not found_a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_a), np.concatenate(found_b)

    def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one group's rows."""
        table = pa.Table.from_batches(parts)
        rows = {c: table.column(c).to_numpy() for c in ("n", "label", "node", "lo", "hi", "block")}
        a, b = pairs(rows | {"bits": _words(table.column("bits"))})
        if len(a):
            yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows so far of the last group
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("key", "lo", "hi")])
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [batch.num_rows]]).tolist()
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                group = key[:, x].tolist()
                if held and group != last:
                    yield from found(held)
                    held = []
                held.append(batch.slice(x, y - x))
                last = group
        if held:
            yield from found(held)

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    k: words of a shingle; percent: link where 100 * intersection >= percent * union. The chance of a missed link is
    given above.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("raw"))
    sketches = stored(texts.mapInArrow(lean(_sketch(k)), "doc_id long, n_shingles long, digest binary, sig binary, bits binary"), "sketches")
    classes = stored(sketches.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"), F.min("bits").alias("bits")), "classes")
    nodes = classes.where("node is not null").select("node", "n", "bits")

    index = classes.where("node is not null").select("node", "sig").mapInArrow(lean(_index), "key long, node long")
    shared = index.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).where("pivot <> other").select("key", "pivot")
    members = stored(index.join(shared, "key").distinct(), "members")
    needed = stored(members.select("node").distinct(), "needed")
    n_needed = needed.count()
    wanted = F.broadcast(needed) if n_needed <= BROADCAST_IDS else needed
    sets = stored(texts.join(wanted, F.col("doc_id") == F.col("node"), "left_semi").mapInArrow(lean(_sets(k)), "node long, shingles binary").where("length(shingles) > 0"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sets.toDF("a", "set_a"), "a")
        return stored(with_a.join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(lean(_confirm(percent)), "a long, b long").distinct(), "links")

    first = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    sized = first.join(nodes.toDF("a", "n_a", "bits_a"), "a").join(nodes.toDF("b", "n_b", "bits_b"), "b")
    sized = sized.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    links = confirmed(sized.mapInArrow(lean(_close(percent)), "a long, b long").distinct())
    labels = components(links, "a", "b")

    placed = stored(members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "placed")
    mixed = placed.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("g")).where("l <> m").select("key", "g")
    rest = stored(placed.join(mixed, "key"), "rest")
    blocks = F.ceil(F.col("g") / BLOCK)
    dealt = rest.join(nodes, "node").withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("key", "node", "label", "n", "bits", "block", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))
    dealt = dealt.repartition(partitions(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    late = dealt.mapInArrow(lean(_across(percent)), "a long, b long").distinct()
    more = confirmed(late)
    if not more.isEmpty():
        labels = components(links.union(more), "a", "b")
    for table in (members, needed, sets, placed, rest):
        forget(table)

    named = classes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("component_id"))
    out = sketches.join(named, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
