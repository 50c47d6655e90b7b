"""Toxicity by the nearest labelled examples: exact TF-IDF cosine through a block-max inverted index.

Examples are a bounded sample of the labelled rows: at most MOST_EXAMPLES of each class, of texts of at most EXAMPLE_BYTES bytes, by a
hash of the id; of equal texts of a class one is drawn from, and of near copies of a class one stays, the next in the draw taking
the place of the others. Only this fit is bounded.

Terms are words (runs of letters, in lower case) and the first PREFIX bytes of longer ones; every term of the examples is in the index.
A term weighs its TF-IDF times its association with the labels (chi-square over the examples): by IDF alone what a text
is about decides its neighbours, and not how it speaks. The README has the figures of both.

The index has a posting list for each term, cut by blocks of BLOCK examples, and the largest impact in each block. Lists that hold over one
in SPARSE of all examples are stored as rows of impacts, zeros included, and taken by one matrix product for many texts; its single
precision only ranks. A text's bound in a block is the most that those give there plus the sum of the other lists' largest
impacts; blocks with the best bounds are read first, then those whose bound reaches the K-th best cosine; cosines near the K-th best are
taken again in double precision. So the K neighbours are exact. Cosine-weighted votes, with a prior for texts that have no neighbour, are calibrated by a
logistic fit on the examples themselves, each without itself, weighted to the classes' shares among all training labels.

The index (some MB, bounded by the sample, checked against MOST_BYTES) goes to the executors once; scoring is one pass without a shuffle.

Rows: a null text is empty and scores by the prior alone. Labels: rows with a null id or label are left out; of several labels
of one id the largest counts, of several texts of one id the least. Only rows whose crc32(doc_id as text) mod FOLDS is not 0 are
learned from. Without labels of both classes every score is the share of label 1 (0 without labels). Equal cosines go to the
smaller example id. Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import LOWER, NOT_LETTER, U64, forget, lean, mix, raw_text, release, steps, stored, word_hashes, word_spans
from roadloom.llm.near_dup import CHUNKS, SYMBOLS, WIDTH, shingle_hashes, signatures

MOST_EXAMPLES = 2000
#: Examples that are drawn for each that is wanted, so that near copies can be replaced.
DRAWN = 2
EXAMPLE_BYTES = 32 << 10
PREFIX = 5
BLOCK = 64
SPARSE = 16
K = 15
FOLDS = 5
#: Symbols of two signatures that agree in near copies: expected from a similarity of two thirds on.
COPY = 30
#: Bytes of a model that may be sent to executors.
MOST_BYTES = 256 << 20
#: Bytes of text and texts scored together.
STEP, ROWS = 1 << 17, 64
#: More than single precision may be wrong by.
NEAR = 1e-5
_SALT = U64(0x5851F42D4C957F2D)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash of a term, times it stands there), ascending, of whole texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = LOWER[data]
    starts, stops, first = word_spans(low, offsets, NOT_LETTER)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    long_ = stops - starts > PREFIX
    heads = mix(word_hashes(low, starts[long_], starts[long_] + PREFIX) ^ _SALT)
    owner, term = np.concatenate([owner, owner[long_]]), np.concatenate([word_hashes(low, starts, stops), heads])
    if not len(term):
        return owner, term, np.zeros(0, np.int64)
    order = np.lexsort((term, owner))
    owner, term = owner[order], term[order]
    at = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])]))
    return owner[at], term[at], np.diff(np.append(at, len(term)))


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, number) for every number of all ranges begin to end."""
    size = end - begin
    which = np.repeat(np.arange(len(size)), size)
    stop = np.cumsum(size)
    return which, np.arange(stop[-1] if len(stop) else 0) - (stop - size)[which] + begin[which]


@dataclass
class Model:
    """Terms (sorted hashes) and their weights; the lists of all; labels and ids of examples.

    full: each term's row of rows, or -1; rows: impacts of all examples. Of the other terms, cells are a term's postings within a block:
    term_cells: each term's first cell; cell_block, cell_most: its block and largest impact; cell_posts: its first posting;
    example, impact: the postings.
    """

    terms: np.ndarray
    weight: np.ndarray
    full: np.ndarray
    rows: np.ndarray
    term_cells: np.ndarray
    cell_block: np.ndarray
    cell_most: np.ndarray
    cell_posts: np.ndarray
    example: np.ndarray
    impact: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    @property
    def size(self) -> int:
        return sum(v.nbytes for v in vars(self).values() if isinstance(v, np.ndarray))

    def weights(self, owner: np.ndarray, term: np.ndarray, times: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term number, normalised weight) of the terms that weigh anything."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        w = (1 + np.log(times)) * self.weight[at]
        use = (self.terms[at] == term) & (w > 0)
        owner, at, w = owner[use], at[use], w[use]
        length = np.sqrt(np.bincount(owner, w * w, texts))
        return owner, at, w / length[owner]

    def nearest(self, owner: np.ndarray, at: np.ndarray, w: np.ndarray, texts: int, k: int = K, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, example, cosine) of the k nearest examples with a cosine over 0, best first; ``but``: one to leave out for each text."""
        blocks, examples = -(-len(self.ids) // BLOCK), len(self.ids)
        row = self.full[at]
        dense = row >= 0
        weights = np.zeros((texts, len(self.rows)), np.float32)
        weights[owner[dense], row[dense]] = w[dense]
        by_rows = weights @ self.rows
        cosine = by_rows.astype(np.float64)
        if but is not None:
            cosine[np.arange(texts), but] = 0
        wide = np.zeros((texts, blocks * BLOCK))
        wide[:, :examples] = cosine
        some, sparse, light = owner[~dense], at[~dense], w[~dense]
        which, cell = _spread(self.term_cells[sparse], self.term_cells[sparse + 1])
        place = some[which] * blocks + self.cell_block[cell]  # text and block
        more = np.bincount(place, light[which] * self.cell_most[cell], texts * blocks).reshape(texts, blocks)
        bound = wide.reshape(texts, blocks, BLOCK).max(axis=2) + more

        def read(wanted: np.ndarray) -> None:
            use = np.flatnonzero(wanted.ravel()[place])
            c = cell[use]
            one, post = _spread(self.cell_posts[c], self.cell_posts[c + 1])
            pair = which[use[one]]
            cosine.ravel()[:] += np.bincount(some[pair] * examples + self.example[post], light[pair] * self.impact[post], texts * examples)
            if but is not None:
                cosine[np.arange(texts), but] = 0

        def kth() -> np.ndarray:
            return np.maximum(0, np.partition(cosine, examples - k, axis=1)[:, examples - k]) if examples > k else np.zeros(texts)

        # the best blocks of each text, then all whose bound reaches its k-th best cosine so far; without more a block's cosines are known
        ahead = min(blocks, k // BLOCK + 3)
        chosen = np.zeros((texts, blocks), bool)
        np.put_along_axis(chosen, np.argpartition(-bound, ahead - 1, axis=1)[:, :ahead], True, axis=1)
        chosen &= more > 0
        read(chosen)
        rest = (more > 0) & (bound >= kth()[:, None] - NEAR) & ~chosen
        if rest.any():
            read(rest)
        # all that may be among the k best, again in double precision, rounded so that equal cosines are equal
        text, example = np.nonzero((cosine > 0) & (cosine >= kth()[:, None] - 2 * NEAR))
        value = cosine[text, example] - by_rows[text, example] + self._by_rows(owner[dense], row[dense], w[dense], texts, text, example)
        order = np.lexsort((self.ids[example], -np.round(value, 9), text))  # ties by id, which does not depend on the label
        text, example, value = text[order], example[order], value[order]
        start = np.searchsorted(text, np.arange(texts))
        top = np.arange(len(text)) - start[text] < k
        return text[top], example[top], value[top]

    def _by_rows(self, owner: np.ndarray, row: np.ndarray, w: np.ndarray, texts: int, text: np.ndarray, example: np.ndarray) -> np.ndarray:
        """What rows give to (text, example) pairs, texts ascending, in double precision."""
        out = np.zeros(len(text))
        begin, cut = np.searchsorted(owner, np.arange(texts + 1)).tolist(), np.searchsorted(text, np.arange(texts + 1)).tolist()
        for a, b, x, y in zip(begin[:-1], begin[1:], cut[:-1], cut[1:], strict=True):
            if y > x:
                out[x:y] = w[a:b] @ self.rows[row[a:b, None], example[x:y]]
        return out

    def votes(self, text: np.ndarray, example: np.ndarray, cosine: np.ndarray, texts: int) -> np.ndarray:
        """Share of label 1 among each text's neighbours, by squared cosine, with the prior counted as one distant neighbour."""
        square = cosine * cosine
        return (np.bincount(text, square * self.labels[example], texts) + 0.05 * self.prior) / (np.bincount(text, square, texts) + 0.05)

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(share) + self.shift, -30, 30))) if len(self.terms) else share

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(score of each text, then text, example and cosine of its neighbours)."""
        texts = len(offsets) - 1
        owner, at, w = self.weights(*term_counts(data, offsets), texts)
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        found = self.nearest(owner, at, w, texts) if len(at) else none
        return self.calibrated(self.votes(*found, texts)), *found


def _logit(share: np.ndarray) -> np.ndarray:
    x = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(x / (1 - x))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method with halved steps and a small ridge; the slope is never negative."""
    start = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)

    def loss(beta: np.ndarray) -> float:
        z = design @ beta
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * ((beta - start) ** 2).sum())

    beta = start
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - (beta - start)
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.eye(2)
        move, now = np.linalg.solve(curve, slope), loss(beta)
        while loss(beta + move) > now and np.abs(move).max() > 1e-9:
            move = move / 2
        beta = beta + move
        if np.abs(move).max() < 1e-8:
            break
    return max(0.05, float(beta[0])), float(beta[1])


@dataclass
class Example:
    """A labelled text: its place in the draw, distinct terms (sorted hashes) and their counts, and its signature (empty without words)."""

    id: int
    label: int
    place: int
    terms: np.ndarray
    times: np.ndarray
    signature: np.ndarray


def without_copies(examples: list[Example], most: int) -> list[Example]:
    """The first ``most`` of each class in the order of the draw, without near copies of earlier ones of their class."""
    seen: dict[bytes, list[np.ndarray]] = {}
    kept: list[Example] = []
    count = [0, 0]
    for e in sorted(examples, key=lambda e: (e.place, e.id)):
        if count[e.label] >= most:
            continue
        parts = e.signature.reshape(CHUNKS, SYMBOLS) if len(e.signature) else []
        keys = [bytes([e.label, k]) + part.tobytes() for k, part in enumerate(parts)]
        if any((e.signature == s).sum() >= COPY for key in keys for s in seen.get(key, ())):
            continue
        for key in keys:
            seen.setdefault(key, []).append(e.signature)
        count[e.label] += 1
        kept.append(e)
    return kept


def fit(examples: list[Example], share: float) -> Model:
    """A model of the examples; share: of label 1 among all training labels."""
    examples = sorted(examples, key=lambda e: e.id)
    labels = np.array([e.label for e in examples], np.float64)
    n, n1 = len(examples), int(labels.sum())
    size = np.array([len(e.terms) for e in examples], np.int64)
    both = 0 < n1 < n
    owner = np.repeat(np.arange(n, dtype=np.int32), size * both)
    terms = np.unique(np.concatenate([e.terms for e in examples])) if both else np.zeros(0, np.uint64)
    at = np.concatenate([np.searchsorted(terms, e.terms).astype(np.int32) for e in examples]) if both else np.zeros(0, np.int32)
    times = np.concatenate([e.times for e in examples]) if both else np.zeros(0, np.int64)
    df, ones = np.bincount(at, minlength=len(terms)), np.bincount(at, labels[owner], len(terms))
    a, b = ones, df - ones
    chi = n * (a * (n - n1 - b) - b * (n1 - a)) ** 2 / np.maximum(1, df * (n - df) * n1 * (n - n1))
    weight = (np.log((1 + n) / (1 + df)) + 1) * chi
    impact = (1 + np.log(times)) * weight[at]
    length = np.sqrt(np.bincount(owner, impact * impact, n))
    impact = (impact / np.where(length > 0, length, 1)[owner]).astype(np.float32)
    # examples of one class whose weightiest terms are the same stand together, so that blocks differ
    lead = np.zeros(n, np.int64)
    by_impact = np.lexsort((impact, owner))
    lead[owner[by_impact]] = at[by_impact]
    del by_impact, times
    place = np.empty(n, np.int32)
    place[np.lexsort((np.arange(n), lead, labels))] = np.arange(n)
    owner = place[owner]
    # rows for the terms of many examples
    full = np.full(len(terms), -1, np.int32)
    many = np.flatnonzero(df * SPARSE > n)
    full[many] = np.arange(len(many))
    rows = np.zeros((len(many), n), np.float32)
    dense = full[at] >= 0
    rows[full[at[dense]], owner[dense]] = impact[dense]
    # postings of the others by term and place; a cell is what one block has of a term
    used = ~dense & (impact > 0)
    owner, at, impact = owner[used], at[used], impact[used]
    order = np.lexsort((owner, at))
    owner, at, impact = owner[order], at[order], impact[order]
    cells = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] // BLOCK != owner[:-1] // BLOCK)])) if len(at) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(impact, cells) if len(cells) else impact
    back = np.argsort(place)
    ids = np.array([e.id for e in examples], np.int64)[back]
    by_cell = np.searchsorted(at[cells], np.arange(len(terms) + 1))
    model = Model(terms, weight, full, rows, by_cell.astype(np.int32), (owner[cells] // BLOCK).astype(np.int32), most, np.append(cells, len(at)).astype(np.int32), owner, impact, labels[back], ids, share)
    if both:
        shares = np.zeros(n)
        for i in range(0, n, ROWS):
            some = examples[i : i + ROWS]
            m = len(some)
            row, term, w = model.weights(np.repeat(np.arange(m), [len(e.terms) for e in some]), np.concatenate([e.terms for e in some]), np.concatenate([e.times for e in some]), m)
            shares[i : i + m] = model.votes(*model.nearest(row, term, w, m, but=place[i : i + m]), m)
        model.slope, model.shift = _logistic(_logit(shares), labels, np.where(labels > 0, share / n1, (1 - share) / (n - n1)) * n)
    return model


def _in_training(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS)) != 0


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms, counts and signature of each text."""
    for batch in batches:
        for i, j, data, offsets in steps(batch.column("raw")):
            owner, term, times = term_counts(data, offsets)
            cut = np.searchsorted(owner, np.arange(j - i + 1))
            hashes, begin = shingle_hashes(data, offsets, 3)
            sig = signatures(hashes, begin)
            own = {c: batch.column(c).slice(i, j - i) for c in ("doc_id", "toxic", "place")}
            bodies = {
                "terms": [term[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)],
                "times": [times[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)],
                "sig": [s.tobytes() if b > a else b"" for s, a, b in zip(sig, begin[:-1], begin[1:], strict=True)],
            }
            yield pa.record_batch(own | {c: pa.array(v, pa.binary()) for c, v in bodies.items()})


def drawn(docs: DataFrame, labels: DataFrame, most: int) -> tuple[list[Example], float]:
    """At most ``most`` training examples of each class, no two of a class near copies, and the share of label 1 among training labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = stored(known.where(_in_training()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    n, n1 = known.agg(F.count("*"), F.sum("toxic")).first()
    if not n:
        return [], 0.0
    text = F.coalesce(F.col("text"), F.lit(""))
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.octet_length("text") <= EXAMPLE_BYTES)
    place = F.xxhash64("doc_id", F.lit(3))
    # of a class's equal texts the first in the draw; only ids and hashes are shuffled
    copies = short.select("doc_id", F.xxhash64(F.lower("text")).alias("same"), F.xxhash64(F.lit(1), F.lower("text")).alias("same2")).join(known, "doc_id")
    distinct = copies.groupBy("toxic", "same", "same2").agg(F.min(F.struct(place.alias("place"), "doc_id")).alias("first")).select("toxic", "first.place", "first.doc_id").distinct()
    ids = [distinct.where(F.col("toxic") == y).orderBy("place", "doc_id").limit(DRAWN * most) for y in (0, 1)]
    sample = stored(ids[0].unionAll(ids[1]).groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.first("place").alias("place")), "sample")
    texts = short.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic", "place").agg(F.min("text").alias("text"))  # 2 * DRAWN * most ids
    rows = stored(texts.select("doc_id", "toxic", "place", raw_text().alias("raw")).mapInArrow(lean(_vectors), "doc_id long, toxic int, place long, terms binary, times binary, sig binary"), "vectors")
    nothing = np.zeros(0, np.uint64)
    all_ = [Example(r.doc_id, r.toxic, r.place, nothing, nothing, np.frombuffer(r.sig, np.uint16)) for r in rows.select("doc_id", "toxic", "place", "sig").collect()]
    kept = {e.id: e for e in without_copies(all_, most)}
    for r in rows.select("doc_id", "terms", "times").toLocalIterator():  # 2 * DRAWN * most vectors
        if r.doc_id in kept:
            kept[r.doc_id].terms, kept[r.doc_id].times = np.frombuffer(r.terms, np.uint64), np.frombuffer(r.times, np.int32)
    for table in (known, sample, rows):
        forget(table)
    return list(kept.values()), (n1 or 0) / n


def train(docs: DataFrame, labels: DataFrame, most_examples: int = MOST_EXAMPLES) -> Model:
    """Fits on at most most_examples labelled documents of each class, those of the smallest id hashes."""
    return fit(*drawn(docs, labels, most_examples))


def _score(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            texts = batch.column("raw") if "raw" in batch.schema.names else pc.fill_null(batch.column("row").field("text"), "")
            for i, j, data, offsets in steps(texts, STEP, ROWS):
                score, text, example, cosine = model.score(data, offsets)
                lists = pa.array(np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32))
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(i, j - i),
                        "row": batch.column("row").slice(i, j - i),
                        "score": pa.array(score, pa.float64()),
                        "neighbours": pa.ListArray.from_arrays(lists, pa.array(model.ids[example], pa.int64())),
                        "cosines": pa.ListArray.from_arrays(lists, pa.array(np.round(cosine, 6), pa.float64())),
                    }
                )

    return run


def toxicity(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, training: DataFrame | None = None) -> DataFrame:
    """(doc_id, row, held_out, score, predicted, neighbours, cosines) for every row of docs(doc_id, text).

    neighbours and cosines are the evidence; row: a struct of the columns named in carry (null for none);
    training: documents to take the labelled texts from, docs by default.
    """
    sc = docs.sparkSession.sparkContext
    model = train(docs if training is None else training, labels)
    release()  # the driver's Python keeps the model only
    if model.size > MOST_BYTES:
        raise ValueError(f"the model has {model.size} bytes, the bound is {MOST_BYTES}: lower most_examples")
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), *([] if carry and "text" in carry else [raw_text().alias("raw")]))
    kind = base.schema["row"].dataType.simpleString()
    out = stored(base.mapInArrow(lean(_score(sc.broadcast(model))), f"doc_id long, row {kind}, score double, neighbours array<long>, cosines array<double>"), "scored")
    held = F.coalesce(~_in_training(), F.lit(False))
    return out.select("doc_id", "row", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "neighbours", "cosines")
