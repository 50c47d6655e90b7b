"""Hierarchical residual best-fit packing of tokenised documents into fixed-length sequences.

Texts are tokenised once into pieces, written to the shared folder and dealt out evenly, so that a sorted corpus packs like a mixed one
(a row of a piece has no text). Each partition packs its pieces by best fit, longest first; bins with at most SLACK free
tokens are final. The others are items of a tree: groups of FAN tasks best-fit theirs together, again and again up to one task.

What a task hands up is bounded: its OPEN emptiest bins. That loses no merge: of two bins that fit together one is at most half
full; best fit leaves a task one such bin at most, so a task of the tree gets FAN of them at most and makes fewer than FAN merges, and
wherever a fuller bin could take part an emptier one could. A task and the levels above it use up FAN bins each, so OPEN = 64 holds
for trees of seven levels, FAN ** 7 partitions. A root task gets FAN * OPEN bins, whatever the corpus has.

A lost executor only repeats scans of written tables, and packing breaks ties by position in them, so it comes out the same.

Rows: a null text is empty and becomes the closing id alone; repeated rows are packed each; a null doc_id is kept. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import LOWER, SPACES, forget, lean, partitions, raw_text, steps, stored, word_hashes, word_spans

CAPACITY = 4096
CLOSING = 1
SLACK = 8
FAN = 8
#: Bins that a task hands up the tree at most.
OPEN = 64
#: Pieces that a task packs at most, about; there are as many tasks as shuffle partitions at least.
TASK_PIECES = 500_000
#: Words whose ids a worker remembers at a time.
MOST_WORDS = 200_000
#: Bytes of text whose words are looked up together.
TEXT_STEP = 1 << 20


# The normalizer and pre-tokenizer for which a word's pieces are found here instead of by the tokenizer.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: A run of these after letters is one piece.
PUNCTUATION = "".join(c for c in string.punctuation if c != "'")
_MARK, _ALNUM = (np.isin(np.arange(256), np.frombuffer(x.encode(), np.uint8)) for x in (PUNCTUATION, string.ascii_letters + string.digits))
#: Below it a character is its own normal form and its lower case doesn't depend on its neighbours, but for the one exception.
SIMPLE, EXCEPTION = "\u0250", "\u0130"


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in prints)
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordIds:
    """Ids of white-space delimited words, remembered; the tokenizer drops white space and never spans it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.simple = told["normalizer"] == NORMALIZER and told["pre_tokenizer"] == PRE_TOKENIZER
        self.special = [t["content"] for t in told["added_tokens"]]
        self.model, self.find, self.characters = self.tokenizer.model, regex.compile(PIECES).findall, _byte_characters()
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.starts, self.flat = array("q", [0]), array("I")

    def _piece(self, piece: str) -> list[int]:
        plain = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.characters)
        return [t.id for t in self.model.tokenize(plain)]

    def word(self, word: bytes) -> list[int]:
        """Ids of one word."""
        text = word.decode("utf-8", "replace")
        core = text.rstrip(PUNCTUATION)
        if self.simple and core.isalpha() and (core.isascii() or (max(core) < SIMPLE and EXCEPTION not in core)):
            ids = self._piece(core.lower())
            return ids + self._piece(text[len(core) :]) if len(core) < len(text) else ids
        if self.simple and (word.isascii() or (max(text) < SIMPLE and EXCEPTION not in text)) and not any(t in text for t in self.special):
            return [i for p in self.find(text.lower()) for i in self._piece(p)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _add(self, word: bytes) -> int:
        if self.simple and word.isalpha():  # ASCII letters: one piece
            self.flat.extend([t.id for t in self.model.tokenize(word.decode())])
        else:
            self.flat.extend(self.word(word))
        self.starts.append(len(self.flat))
        k = self.index[word] = len(self.starts) - 2
        return k

    def _split(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and stops of words cut before the punctuation that follows a letter or digit, and the first part of each word."""
        if not self.simple:
            return starts, stops, np.arange(len(starts) + 1)
        core = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))[stops - 1] + 1
        last, lead = data[core - 1], data[np.maximum(core - 2, 0)]
        # the last character is a letter or digit of ASCII, or a letter of two bytes
        two = (last >= 0x80) & (last < 0xC0) & (lead >= 0xC3) & (lead < 0xCA) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7))) & ~((lead == 0xC4) & (last == 0xB0))
        cut = (core > starts) & (core < stops) & (_ALNUM[last] | (two & (core - 2 >= starts)))
        raw = data.tobytes()
        for token in self.special:
            at = raw.find(token.encode())
            while at >= 0:
                cut[np.searchsorted(starts, at, side="right") - 1] = False
                at = raw.find(token.encode(), at + 1)
        begin = np.arange(len(starts) + 1) + np.concatenate([[0], np.cumsum(cut)])
        a, b = np.empty(begin[-1], np.int64), np.empty(begin[-1], np.int64)
        a[begin[:-1]], b[begin[1:] - 1] = starts, stops
        b[begin[:-1][cut]] = a[begin[:-1][cut] + 1] = core[cut]
        return a, b, begin

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's first id; equal words, compared by their bytes, are looked up once."""
        if self.simple:
            data = LOWER[data]
        starts, stops, first = word_spans(data, offsets, SPACES)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.index) > MOST_WORDS:
            self.clear()
        starts, stops, parts = self._split(data, starts, stops)
        first = parts[first]
        _, lead, same = np.unique(word_hashes(data, starts, stops), return_index=True, return_inverse=True)
        raw = data.tobytes()
        get, add = self.index.get, self._add
        unique = [raw[a:b] for a, b in zip(starts[lead].tolist(), stops[lead].tolist(), strict=True)]
        place = np.array([k if (k := get(w)) is not None else add(w) for w in unique], np.int64)[same]
        for other in np.flatnonzero(~_equal(data, starts, stops, lead[same])).tolist():  # words of one hash that differ
            word = raw[starts[other] : stops[other]]
            place[other] = k if (k := get(word)) is not None else add(word)
        flat, heads = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.starts, np.int64)
        begin, n = heads[place], heads[place + 1] - heads[place]
        ends = np.concatenate([[0], np.cumsum(n)])
        return flat[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], n)] if ends[-1] else np.zeros(0, np.uint32), ends[first]


def _equal(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Whether each word has the bytes of its lead, another word."""
    size = stops - starts
    same = size == size[lead]
    some = np.flatnonzero(same & (lead != np.arange(len(lead))))
    size = size[some]
    stop = np.cumsum(size)
    at = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size, size)
    differ = data[at + np.repeat(starts[some], size)] != data[at + np.repeat(starts[lead[some]], size)]
    if differ.any():
        same[some[np.searchsorted(stop, np.flatnonzero(differ), side="right")]] = False
    return same


_words: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    """This worker's, made once."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path)
        for batch in batches:
            for i, j, data, offsets in steps(batch.column("raw"), TEXT_STEP):
                all_ids, begin = words.ids(data, offsets)
                row, piece, start, length, crc, body = [], [], [], [], [], []
                closing = np.array([CLOSING], "<u4")
                for r, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                    ids = np.concatenate([all_ids[a:b], closing]).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        cut = ids[at : at + capacity].tobytes()
                        row.append(r)
                        piece.append(k)
                        start.append(at)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        body.append(cut if with_ids else None)
                columns = {
                    "doc_id": batch.column("doc_id").slice(i, j - i).take(pa.array(row, pa.int64())),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                yield pa.record_batch(columns | ({"ids": pa.array(body, pa.binary())} if with_ids else {}))

    return run


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin and offset of each item, fill of each bin): longest first, each into the fullest bin that takes it."""
    bin_of, offset, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit r: a bin has r free
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = there >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                there ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bin_of[item], offset[item] = b, fills[b]
        fills[b] += size
        room -= size
        if not free[room]:
            there |= 1 << room
        free[room].append(b)
    return bin_of, offset, np.array(fills, np.int64)


def _pack(size: str, capacity: int, names: tuple[str, str, str]):
    """Packs all rows of a partition; names of the columns for bin, offset and fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        bin_of, offset, fills = best_fit(table.column(size).to_numpy(), capacity)
        first = TaskContext.get().partitionId() << 40
        for name, values in zip(names, (bin_of + first, offset, fills[bin_of]), strict=True):
            table = table.append_column(name, pa.array(values, pa.int64()))
        yield from table.to_batches()

    return run


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, if asked for, ids as little-endian 32-bit words) of docs(doc_id, text)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("raw"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return base.mapInArrow(lean(_pieces(tokenizer, capacity, with_ids)), kind)


def _emptiest(bins: DataFrame, capacity: int) -> DataFrame:
    """Of each group's (bin, size, group) that aren't nearly full the OPEN emptiest."""
    first = Window.partitionBy("group").orderBy("size", "bin")
    return bins.where(F.col("size") < capacity - SLACK).withColumn("n", F.row_number().over(first)).where(F.col("n") <= OPEN).drop("n")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces, a table of rows with a length of 1 to capacity."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    pieces = pieces.repartition(max(partitions(pieces.sparkSession), -(-pieces.count() // TASK_PIECES)))
    placed = stored(pieces.mapInArrow(lean(_pack("length", capacity, ("bin", "offset", "fill"))), f"{kind}, bin long, offset long, fill long"), "placed")
    groups = (placed.agg(F.max(F.shiftright("bin", 40))).first()[0] or 0) + 1
    heads = placed.where(F.col("offset") == 0).select("bin", F.col("fill").alias("size"), F.shiftright("bin", 40).alias("group"))
    moved = None  # bin of level 0 -> where it is now
    depth, done = 0, []
    while groups > 1:
        depth += 1
        open_ = _emptiest(heads, capacity).withColumn("group", F.floor(F.col("group") / FAN))
        groups = -(-groups // FAN)
        # equal groups are in one partition; a partition of several groups only packs better
        kind = "bin long, size long, group long, to long, base long, fill long"
        dealt = open_.repartition(groups, "group").sortWithinPartitions("group", F.desc("size"), "bin")
        step = stored(dealt.mapInArrow(lean(_pack("size", capacity, ("to", "base", "fill"))), kind).withColumn("to", F.col("to") + F.lit(depth).cast("long") * F.lit(1 << 58)), f"level{depth}")
        at = step.select(F.col("bin").alias("was"), "to", F.col("base").alias("more"))
        if moved is None:
            moved = at.select(F.col("was").alias("bin"), F.col("to").alias("now"), F.col("more").alias("base"))
        else:
            joined = moved.join(at, moved["now"] == at["was"], "full")
            moved = joined.select(F.coalesce("bin", "was").alias("bin"), F.coalesce("to", "now").alias("now"), (F.coalesce("base", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("base"))
        moved = stored(moved, f"moved{depth}")
        for table in done:
            forget(table)
        done = [step, moved]
        heads = step.where(F.col("base") == 0).select(F.col("to").alias("bin"), F.col("fill").alias("size"), "group")
    own = [f.name for f in pieces.schema]
    if moved is None:
        return placed.select(*own, F.col("bin").alias("sequence_id"), "offset")
    out = placed.join(moved, "bin", "left")
    return out.select(*own, F.coalesce("now", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row of docs, in its place."""
    pieces = stored(tokenised(docs, tokenizer, capacity), "pieces")
    out = pack(pieces, capacity)
    forget(pieces)
    return out
