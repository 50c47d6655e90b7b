"""Edit-aware token counts: a segment tree of pre-token segments for each document.

A text is cut into segments of LEAF characters or a little more, each cut at a place where the pre-tokenizer always cuts: after a letter
or a digit and before a character of another kind (no pre-token goes on after either but with its own kind). So segments are
counted apart. What has no such place, a single run of letters or of other characters, is one pre-token and one segment.

Segments stand in chunks of at most 2 * CHUNK; a tree over the chunks has the sums of their characters and tokens, and an edit's place is
found by going down it. An edit re-encodes only the segments it touches, and a neighbour where it leaves no cut between them; then the
sums on the path up from its chunk are updated. So an edit costs a few segments and the height of the tree, not the document; a
chunk that grows too long is split, after at least CHUNK new segments.

Rows: a null text is empty and has one leaf of 0; null and empty edit lists change nothing; edits are (start, end, replacement) in
characters of the old text, in order, and must not overlap (else an error); repeated rows are counted each, a null
doc_id is kept. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import lean

LEAF = 400
CHUNK = 32
#: What the query's edits mask: digit runs and mail addresses.
MASKED, MASK = re.compile(r"[0-9]{3,}|[^\s@]+@[^\s@]+\.[a-z]+"), "<masked>"
#: A place where any text is cut: a letter or digit, then something else.
_CUT = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")


def cuts(text: str, leaf: int = LEAF) -> list[int]:
    """Starts of the segments of a text."""
    out = [0]
    while found := _CUT.search(text, out[-1] + leaf):
        out.append(found.start())
    return out


def _border(left: str, right: str) -> bool:
    """Whether the pre-tokenizer cuts between the two wherever they stand."""
    return bool(left and right) and _CUT.search(left[-1] + right[0]) is not None


class SegmentTree:
    """Sums of (characters, tokens) over leaves in arrays: node i has the children 2i and 2i + 1, leaves begin at ``width``."""

    def __init__(self, leaves: list[tuple[int, int]]):
        self.n, self.width = len(leaves), 1 << max(0, len(leaves) - 1).bit_length()
        rest = [0] * (self.width - len(leaves))
        self.chars = [0] * self.width + [c for c, _ in leaves] + rest
        self.tokens = [0] * self.width + [t for _, t in leaves] + rest
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def add(self, leaf: int, chars: int, tokens: int) -> None:
        """Changes a leaf and the sums above it."""
        i = self.width + leaf
        while i:
            self.chars[i] += chars
            self.tokens[i] += tokens
            i //= 2

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, characters before it) of the leaf that has character ``at``; the last one from the end on."""
        if at >= self.chars[1]:
            last = self.n - 1
            return last, self.chars[1] - self.chars[self.width + last]
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if at >= before + self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.width, before


class CountedText:
    """A text as segments with their tokens, in chunks under a tree of sums; count: tokens of a string."""

    def __init__(self, text: str, count: Callable[[str], int], leaf: int = LEAF):
        self.count, self.leaf = count, leaf
        starts = cuts(text, leaf)
        parts = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        self.chunks = [parts[k : k + CHUNK] for k in range(0, len(parts), CHUNK)]
        self.counts = [[count(p) for p in chunk] for chunk in self.chunks]
        self._sum()
        self.encoded = 0  # characters encoded by edits

    def _sum(self) -> None:
        self.tree = SegmentTree([(sum(map(len, c)), sum(n)) for c, n in zip(self.chunks, self.counts, strict=True)])

    def __len__(self) -> int:
        return self.tree.chars[1]

    @property
    def text(self) -> str:
        return "".join(p for chunk in self.chunks for p in chunk)

    @property
    def starts(self) -> list[int]:
        out, at = [], 0
        for chunk in self.chunks:
            for p in chunk:
                out.append(at)
                at += len(p)
        return out

    def leaves(self) -> list[int]:
        """Tokens of each segment."""
        return [n for chunk in self.counts for n in chunk]

    def _find(self, at: int) -> tuple[int, int, int]:
        """(chunk, segment in it, characters before that) of character ``at``."""
        chunk, before = self.tree.find(at)
        parts = self.chunks[chunk]
        k = 0
        while k < len(parts) - 1 and at >= before + len(parts[k]):
            before += len(parts[k])
            k += 1
        return chunk, k, before

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Applies edits, last first, so that earlier places stay as they are; those within one segment are encoded together."""
        last = len(self) + 1
        waiting: list[tuple[int, int, str]] = []  # descending, all within the segment from low on
        low = -1
        for start, end, new in reversed(edits):
            if not 0 <= start <= end <= len(self) or end > last:
                raise ValueError(f"edit ({start}, {end}) is outside of the text or overlaps another")
            last = start
            if waiting and start >= low:
                waiting.append((start, end, new))
                continue
            if waiting:
                self._apply(waiting)
            waiting, low = [(start, end, new)], self._find(start)[2]
        if waiting:
            self._apply(waiting)

    def _apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits, descending, whose starts are in one segment: encodes what they touch again and puts it in place."""
        chunk, first, begin = self._find(edits[-1][0])
        stop_chunk, stop, finish = self._find(edits[0][1])
        finish += len(self.chunks[stop_chunk][stop])
        parts = self._between(chunk, first, stop_chunk, stop)
        old = "".join(parts)
        pieces, at = [], finish
        for start, end, new in edits:
            pieces += [old[end - begin : at - begin], new]
            at = start
        region = "".join([old[: at - begin], *reversed(pieces)])
        # boundary context: a neighbour whose border with the region is no cut any more is encoded, too
        while (before := self._step(chunk, first, -1)) and not _border(self.chunks[before[0]][before[1]], region):
            chunk, first = before
            region = self.chunks[chunk][first] + region
        while (after := self._step(stop_chunk, stop, 1)) and not _border(region, self.chunks[after[0]][after[1]]):
            stop_chunk, stop = after
            region += self.chunks[stop_chunk][stop]
        inner = cuts(region, self.leaf)
        new_parts = [region[a:b] for a, b in zip(inner, [*inner[1:], len(region)], strict=True)]
        new_counts = [self.count(p) for p in new_parts]
        self.encoded += len(region)
        self._replace(chunk, first, stop_chunk, stop, new_parts, new_counts)

    def _step(self, chunk: int, k: int, way: int) -> tuple[int, int] | None:
        """The segment before or after another."""
        k += way
        if 0 <= k < len(self.chunks[chunk]):
            return chunk, k
        chunk += way
        if not 0 <= chunk < len(self.chunks):
            return None
        return chunk, 0 if way > 0 else len(self.chunks[chunk]) - 1

    def _between(self, chunk: int, first: int, stop_chunk: int, stop: int) -> list[str]:
        if chunk == stop_chunk:
            return self.chunks[chunk][first : stop + 1]
        middle = [p for c in self.chunks[chunk + 1 : stop_chunk] for p in c]
        return self.chunks[chunk][first:] + middle + self.chunks[stop_chunk][: stop + 1]

    def _replace(self, chunk: int, first: int, stop_chunk: int, stop: int, parts: list[str], counts: list[int]) -> None:
        if chunk == stop_chunk and len(self.chunks[chunk]) - (stop + 1 - first) + len(parts) <= 2 * CHUNK:
            was, n = self.chunks[chunk], self.counts[chunk]
            chars = sum(map(len, parts)) - sum(map(len, was[first : stop + 1]))
            self.tree.add(chunk, chars, sum(counts) - sum(n[first : stop + 1]))
            was[first : stop + 1], n[first : stop + 1] = parts, counts
            return
        # the region spans chunks or makes its chunk too long: what is left of them and the new segments are cut into chunks anew
        parts = self.chunks[chunk][:first] + parts + self.chunks[stop_chunk][stop + 1 :]
        counts = self.counts[chunk][:first] + counts + self.counts[stop_chunk][stop + 1 :]
        self.chunks[chunk : stop_chunk + 1] = [parts[k : k + CHUNK] for k in range(0, len(parts), CHUNK)]
        self.counts[chunk : stop_chunk + 1] = [counts[k : k + CHUNK] for k in range(0, len(counts), CHUNK)]
        self._sum()


def mask_edits(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), MASK) for m in MASKED.finditer(text)]


_counters: dict[str, Callable[[str], int]] = {}


def counter(path: str) -> Callable[[str], int]:
    """Counts tokens by the ranks file of a byte-level BPE."""
    if path not in _counters:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _counters[path] = lambda text: len(encoding.encode_ordinary(text))
    return _counters[path]


def _count(path: str, edits_of, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            rows = []
            given = batch.column("edits").to_pylist() if "edits" in batch.schema.names else [None] * batch.num_rows
            for text, edits in zip(batch.column("text").to_pylist(), given, strict=True):
                text = text or ""
                counted = CountedText(text, count, leaf)
                before, n_leaves = counted.tree.total, len(counted.leaves())
                edits = edits_of(text) if edits_of else [(e["start"], e["end"], e["replacement"] or "") for e in edits or []]
                counted.edit(edits)
                rows.append((before, counted.tree.total, len(edits), n_leaves, counted.encoded, counted.starts, counted.leaves(), counted.tree.tokens))
            columns = ("n_tokens", "n_tokens_after", "n_edits", "n_leaves", "n_chars_encoded")
            lists = ("starts", "leaves", "tree")
            out = {"doc_id": batch.column("doc_id")} | {c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(columns)}
            yield pa.record_batch(out | {c: pa.array([r[5 + k] for r in rows], pa.list_(pa.int64())) for k, c in enumerate(lists)})

    return run


def edited_counts(docs: DataFrame, ranks: str, edits_of: Callable[[str], list[tuple[int, int, str]]] | None = None, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_after, n_edits, n_leaves, n_chars_encoded, starts, leaves, tree) for every row of docs(doc_id, text).

    Edits come from edits_of(text), or from a column edits, an array of (start, end, replacement). starts, leaves and tree are the state
    after the edits: segments' starts and tokens, and the sums over chunks of them. n_leaves is before, n_chars_encoded what the edits encoded again.
    """
    columns = ["doc_id", "text", *(["edits"] if edits_of is None and "edits" in docs.columns else [])]
    base = docs.select(*columns).withColumn("doc_id", F.col("doc_id").cast("long"))
    kind = "doc_id long, n_tokens long, n_tokens_after long, n_edits long, n_leaves long, n_chars_encoded long, starts array<long>, leaves array<long>, tree array<long>"
    return base.mapInArrow(lean(_count(ranks, edits_of, leaf)), kind)
