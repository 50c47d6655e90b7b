"""Archives, toxicity, host rules, snapshots, sharding, packing, token counts and the pipeline on small fixtures."""

import hashlib
import io
import os
import random
import re
import struct
import time
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roadloom.llm import near_dup, packing, quality_rules, queries, sharding, snapshots, token_counts, toxicity, warc

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, raw string, row string, bin long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x", "y", 5) for i, t in rows], DOCS)


# --- archives -------------------------------------------------------------------------------------


class File:
    def __init__(self, data):
        self.data, self.reads = data, []

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        self.reads.append((at, n))
        return self.data[at : at + n]


def test_reader_of_zip_files():
    for before, comment, wide in ((b"", b"", False), (b"junk" * 100, b"a comment", False), (b"", b"", True), (b"x" * 77, b"PK\x05\x06", True)):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k in range(5):
                with z.open(zipfile.ZipInfo(f"dir/ü{k}.bin"), "w", force_zip64=wide) as f:
                    f.write(bytes([k]) * (k * 1000))
            z.writestr("packed", b"z" * 1000, zipfile.ZIP_DEFLATED)
            z.comment = comment
        reader = warc.ZipReader(File(before + out.getvalue()))
        assert len(reader.members) == 6
        assert all(reader.read(f"dir/ü{k}.bin") == bytes([k]) * (k * 1000) for k in range(5))
        with pytest.raises(ValueError, match="compressed"):
            reader.read("packed")


def test_zip64_end_records():
    """An archive whose end record is full: entries, size and offset come from the ZIP64 record behind the locator."""
    body, name = b"payload", b"m"
    local = struct.pack("<IHHHHHIIIHH", warc.LOCAL, 45, 0, 0, 0, 0, 0, warc.FULL32, warc.FULL32, 1, 20) + name + struct.pack("<HHQQ", 1, 16, 7, 7) + body
    central = struct.pack("<IHHHHHHIIIHHHHHII", warc.CENTRAL, 45, 45, 0, 0, 0, 0, 0, warc.FULL32, warc.FULL32, 1, 28, 0, 0, 0, 0, warc.FULL32) + name + struct.pack("<HHQQQ", 1, 24, 7, 7, 0)
    end64 = struct.pack("<IQHHIIQQQQ", warc.END64, 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<IIQI", warc.LOCATOR64, 0, len(local) + len(central), 1)
    end = struct.pack("<IHHHHIIH", warc.END, 0, 0, warc.FULL16, warc.FULL16, warc.FULL32, warc.FULL32, 0)
    data = local + central + end64 + locator + end
    for before in (b"", b"prefix"):
        assert warc.ZipReader(File(before + data)).read("m") == body
    with pytest.raises(ValueError):
        warc.ZipReader(File(b"no archive at all, but long enough for an end record"))


def test_records_are_range_read():
    records = [warc.record(k, f"http://h/{k}?a=é b", os.urandom(5000), "0" * 64, None) for k in range(200)]
    file = File(warc.archive(records))
    found = list(warc.records_of(warc.ZipReader(file)))
    assert [h["warc-record-id"] for h, _ in found] == [f"<urn:page:{k}>" for k in range(200)]
    assert max(n for _, n in file.reads) < len(file.data) + 1 and len(file.reads) < 12


def test_archives_round_trip(spark):
    long_, other = "é" * 60, "b" * 100
    rows = [(5, "http://a", long_), (3, "u r l\r\nX: y", long_), (9, None, long_), (1, "", "short"), (2, "", "short"), (4, "x", None), (6, "x", ""), (None, "x", other), (7, "y", other), (8, "p", "c" * 99), (10, "p", "c" * 99), (7, "y", other), (11, "q", "line\r\n\r\nline\x00" * 20)]
    pages = spark.createDataFrame([(*r, "z", "w") for r in rows], "page_id long, url string, html string, digest string, lead string")
    got = warc.round_trip(pages.repartition(3)).collect()
    key = lambda i, u, h: (i, u, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest())
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest) for r in got), key=repr) == sorted((key(*r) for r in rows), key=repr)
    refers = {(r.page_id, r.url): (r.record_type, r.refers_to) for r in got}
    assert refers[5, "http://a"] == ("revisit", 3) and refers[9, None] == ("revisit", 3)
    assert refers[3, "u r l\r\nX: y"] == ("response", None) and refers[None, "x"] == ("revisit", 7) and refers[7, "y"] == ("response", None)
    assert all(refers[k][0] == "response" for k in ((1, ""), (2, ""), (4, "x"), (6, "x"), (8, "p"), (10, "p")))
    assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert warc.round_trip(pages.limit(0)).count() == 0


# --- toxicity -------------------------------------------------------------------------------------


def toxic_rows(n=400):
    rng = random.Random(2)
    words = [f"word{k}" for k in range(300)]
    bad = ["scummy", "vileness", "loathing"]
    out = []
    for i in range(n):
        w, toxic = rng.choices(words, k=rng.randint(20, 60)), i % 5 == 0
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        out.append((i, " ".join(w), int(toxic)))
    return out


def texts_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def examples_of(rows):
    data, offsets = texts_of([t for _, t, _ in rows])
    owner, term, times = toxicity.term_counts(data, offsets)
    hashes, begin = near_dup.shingle_hashes(data, offsets, 3)
    sig = near_dup.signatures(hashes, begin)
    return [toxicity.Example(i, y, k, term[owner == k], times[owner == k], sig[k] if begin[k + 1] > begin[k] else sig[k][:0]) for k, (i, _, y) in enumerate(rows)]


def dense(model):
    """Impacts as a term x example matrix."""
    out = np.zeros((len(model.terms), len(model.ids)))
    for t in range(len(model.terms)):
        a, b = model.cell_posts[model.term_cells[t]], model.cell_posts[model.term_cells[t + 1]]
        out[t, model.example[a:b]] = model.impact[a:b]
        if model.full[t] >= 0:
            out[t] = model.rows[model.full[t]]
    return out


def test_terms_are_words_and_their_heads():
    text = "Über the Überlegen, THE-x2y naïve\n"
    data, offsets = texts_of([text, "", text])
    owner, term, times = toxicity.term_counts(data, offsets)
    assert set(owner.tolist()) == {0, 2} and (term[owner == 0] == term[owner == 2]).all()
    # the, x, y, Über, Überlegen, naïve and the heads of the longer two; "the" stands twice
    assert sorted(times[owner == 0].tolist()) == [1] * 7 + [2]


@pytest.mark.parametrize(("block", "sparse"), [(4, 16), (64, 16), (16, 2), (16, 10**9), (16, 1)])
def test_nearest_are_exact(monkeypatch, block, sparse):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "SPARSE", sparse)
    model = toxicity.fit(examples_of(toxic_rows(300)), 0.2)
    full = dense(model)
    assert len(model.terms) == len(np.unique(np.concatenate([e.terms for e in examples_of(toxic_rows(300))])))  # all terms of the examples
    texts = [t for _, t, _ in toxic_rows(360)[300:]] + ["", "scummy", "nothing known here", toxic_rows(1)[0][1]]
    owner, at, w = model.weights(*toxicity.term_counts(*texts_of(texts)), len(texts))
    text, example, cosine = model.nearest(owner, at, w, len(texts))
    for k in range(len(texts)):
        cosines = w[owner == k] @ full[at[owner == k]] if (owner == k).any() else np.zeros(full.shape[1])
        order = np.lexsort((model.ids, -np.round(cosines, 9)))
        order = order[cosines[order] > 0][: toxicity.K]
        assert example[text == k].tolist() == order.tolist() and np.allclose(cosine[text == k], cosines[order], atol=1e-6)


def test_equal_cosines_go_to_the_smaller_id():
    rows = [(i, "abcde" if i % 2 else "vwxyz", 1) for i in range(40)] + [(100 + i, "fine", 0) for i in range(40)]
    model = toxicity.fit(examples_of(rows), 0.5)
    found = model.score(*texts_of(["vwxyz", "vwxyz"]))
    assert model.ids[found[2]].tolist() == [*range(0, 30, 2)] * 2 and (found[1] == np.repeat([0, 1], 15)).all()


def test_copies_are_replaced_within_a_class():
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 400)}" for _ in range(80)]
    near = lambda: " ".join(w if rng.random() > 0.01 else "other" for w in base)
    rows = [(i, near(), 1) for i in range(30)] + [(50 + i, " ".join(f"v{rng.randint(0, 400)}" for _ in range(60)), 1) for i in range(10)] + [(90, near(), 0), (91, "", 0)]
    kept = toxicity.without_copies(examples_of(rows), 8)
    assert [e.label for e in kept].count(1) == 8 and sum(e.id < 30 for e in kept) == 1  # the others' places are taken by the next in the draw
    assert {e.id for e in kept if not e.label} == {90, 91}  # a copy of another class stays


def test_scores_are_calibrated():
    """Among texts of a score the share of label 1 is about that score, where labels are noisy."""
    rng = random.Random(4)
    words = [f"word{k}" for k in range(60)]
    def row(i):
        bad = rng.random()
        t = rng.choices(words, k=20) + ["venom"] * (bad < 0.5)
        return i, " ".join(t), int(rng.random() < (0.8 if bad < 0.5 else 0.1))
    model = toxicity.fit(examples_of([row(i) for i in range(600)]), 0.45)
    test = [row(i) for i in range(600)]
    score = model.score(*texts_of([t for _, t, _ in test]))[0]
    truth = np.array([y for _, _, y in test])
    assert abs(score.mean() - truth.mean()) < 0.1 and score[truth == 1].mean() > score[truth == 0].mean() + 0.2


def test_toxicity_of_held_out_rows(spark):
    rows = toxic_rows() + [(1000, None, 0), (1001, "", 0)]
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(3, 0, 0), (None, 0, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    table = docs(spark, [r[:2] for r in rows] + [(None, "scummy vileness"), (5000, "scummy vileness " * 5000)])
    got = toxicity.toxicity(table.repartition(3), labels, carry=["row"]).collect()
    want = {i: y for i, _, y in rows}
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + 2 and all(r.row.row == "y" and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None) and by[None].held_out is False
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.98 * len(held)
    assert by[5000].predicted == 1 and by[None].predicted == 1 and by[1000].predicted == by[1001].predicted == 0
    assert all(zlib.crc32(str(i).encode()) % 5 for r in got for i in r.neighbours)
    assert all(len(r.neighbours) == len(r.cosines) <= toxicity.K and list(r.cosines) == sorted(r.cosines, reverse=True) for r in got)
    assert {r.row.row for r in toxicity.toxicity(table, labels.limit(0), carry=["row", "text"]).collect()} == {"y"}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity(docs(spark, [(1, "a b")]), none).collect()] == [0.0]
    assert toxicity.toxicity(docs(spark, []), none).count() == 0


# --- host rules -----------------------------------------------------------------------------------


def brute_counters(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_host_rules(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        n = rng.choice([0, 1, 2, 3, 10, 60, 90])
        w = rng.choices(["a", "bé", "#x", "c$%", "😀", "d"] if i % 3 else [f"v{k}" for k in range(500)], k=n)
        rows.append((i, "".join(x + rng.choice([" ", "\n", "\t", "\r\n", "  \n \n"]) for x in w), f"h{i % 4}"))
    rows += [(200, None, "bad"), (201, "", "bad"), (202, "x y z x y z", "bad"), (203, "one", "bad"), (None, "v1 " * 60, None), (3, rows[3][1], "h3"), (204, " ".join(f"u{k}" for k in range(99)), "bad"), (205, "r s t " * 4000, "h1")]
    table = spark.createDataFrame([(*r, "x", 1, [2]) for r in rows], "doc_id long, text string, source string, host string, n int, words array<int>")
    got = quality_rules.quality(table.repartition(3)).collect()
    counts = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr)
    assert counts == sorted(((i, *(brute_counters(t) if i != 205 else (12000, 12000, 0, 0, 12000))) for i, t, _ in rows), key=repr)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    judged = {}
    for i, t, h in rows:
        c = brute_counters(t) if i != 205 else (12000, 0, 0, 0, 12000)
        judged.setdefault(h or "", []).append(c[0] < 50 or 2 * c[4] > c[0])
    rates = [np.mean(v) for v in judged.values()]
    mean, spread = np.mean(rates), np.var(rates)
    weight = max(0, mean * (1 - mean) / spread - 1)
    bad = {h for h, v in judged.items() if (sum(v) + mean * weight) / (len(v) + weight) > 0.5}
    assert bad and {r.kept for r in got if r.doc_id == 204} == {"bad" not in bad}
    good = {i for i, t, h in rows if (h or "") not in bad}
    assert all(r.kept == (not r.base_failed and r.doc_id in good) for r in got if r.doc_id not in (3, None))
    assert quality_rules.quality(table.limit(0)).count() == 0


# --- snapshots ------------------------------------------------------------------------------------


def test_snapshots(spark):
    talk = lambda *t: [("user" if k % 2 == 0 else "assistant", x) for k, x in enumerate(t)]
    logs = {1: talk("a"), 2: talk("a", "b"), 3: talk("a", "b", "c"), 4: talk("a", "x"), 5: talk("a", "b", "c"), 6: [("user", None)], 7: [("user", "")], 8: [(None, "q")], 9: talk("b"), 10: talk("a", "b", "d"), 11: [("user", "z" * 50000)]}
    rows = [(c, k, r, t, "x", 1) for c, turns in logs.items() for k, (r, t) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, place string, n int")
    got = {r.conv_id: r for r in snapshots.collapse(table.repartition(3)).collect()}

    def maximal(c):
        return not any((len(o) > len(logs[c]) or (len(o) == len(logs[c]) and d < c)) and o[: len(logs[c])] == logs[c] for d, o in logs.items() if d != c)

    assert set(got) == {c for c in logs if maximal(c)}
    assert got[3].n_equal == 2 and got[3].n_turns == 3
    assert got[3].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    again = snapshots.collapse(table.union(table.where("conv_id = 4"))).where("conv_id = 4").first()
    assert again.n_turns == 4
    null = snapshots.collapse(table.withColumn("conv_id", F.when(F.col("conv_id") != 9, F.col("conv_id")))).where("conv_id is null").first()
    assert null.n_turns == 1
    assert snapshots.collapse(table.limit(0)).count() == 0


# --- sharding -------------------------------------------------------------------------------------


@pytest.mark.parametrize("blocks", [7, 50, 20000])
def test_sharding(spark, blocks):
    rng = random.Random(blocks)
    texts = ["é" * rng.randint(0, 200) for _ in range(120)]
    rows = [(rng.randint(0, 10**6), rng.choice(texts)) for _ in range(500)] + [(-5, "h" * 900)] * 12 + [(None, None), (7, None), (8, ""), (None, "h" * 900)]
    got = sharding.shard(docs(spark, rows).repartition(3), 24, blocks).collect()
    assert len(got) == len(rows)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    load, slots = {}, {}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for i, t in rows:
        g = groups.setdefault(t or "", [[], 0])
        g[0].append(-(1 << 70) if i is None else i)
        g[1] += len((t or "").encode()) + 8
    first = lambda t: min([x for x in groups[t][0] if x > -(1 << 70)], default=-(1 << 70))
    sizes = np.array([groups[t][1] for t in sorted(groups, key=lambda t: (first(t), hashlib.sha256(t.encode()).digest()))])
    assert max(load.values()) == sharding.smallest_capacity(sizes, 24)
    by_size = {}
    for r in got:
        by_size.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in by_size.values())


def test_capacity_is_the_least():
    rng = random.Random(8)
    for _ in range(60):
        sizes = np.array([rng.randint(1, 30) for _ in range(rng.randint(1, 9))])
        shards = rng.randint(1, 5)

        def best(at, left):
            if left == 1:
                return sizes[at:].sum()
            return min(max(sizes[at:cut].sum(), best(cut, left - 1)) for cut in range(at, len(sizes) + 1))

        capacity = sharding.smallest_capacity(sizes, shards)
        assert capacity == best(0, shards)
        cuts = [0, *sharding.balanced(sizes, capacity, shards), len(sizes)]
        assert cuts == sorted(cuts) and max(sizes[a:b].sum() for a, b in zip(cuts[:-1], cuts[1:], strict=True)) == capacity


def test_sharding_of_few_rows(spark):
    assert sharding.shard(docs(spark, [])).count() == 0
    assert [(r.slot, r["size"]) for r in sharding.shard(docs(spark, [(1, "a")])).collect()] == [(0, 9)]


# --- packing --------------------------------------------------------------------------------------

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLACK", 2)
    rng = random.Random(1)
    alphabet = ["the", "Straße", "it's", "naïve", "x9", "中文", "<|endoftext|>", "…", "a.b,c!", "İs", "ΣΑΣ", " ", "\x1f", "😀", "'ll", "²", "\x00q"]
    rows = [(i, " ".join(rng.choices(alphabet, k=rng.choice([0, 1, 5, 40, 200])))) for i in range(80)] + [(90, None), (91, ""), (None, "the the"), (None, "the the"), (92, "the " * 700)]
    table = docs(spark, rows).repartition(5)
    capacity = 128
    got = packing.packed(table, WORD_BPE, capacity).collect()
    tokenizer = tokenizers.Tokenizer.from_file(WORD_BPE)
    want = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == list(np.cumsum([0, *(n for _, n in parts[:-1])])) and sum(n for _, n in parts) <= capacity
    total = sum(w[3] for w in want)
    assert len(sequences) <= -(-total // capacity) + 2
    assert packing.packed(docs(spark, []), WORD_BPE).count() == 0


def test_tree_merges_what_partitions_leave(spark):
    rows = spark.range(64).select(F.col("id").alias("k"), (F.col("id") % 3 * 10 + 20).alias("length")).repartition(32)
    got = packing.pack(rows, 100).collect()
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert len(got) == 64 and max(fill.values()) <= 100 and len(fill) < 32  # fewer than one a partition


def test_the_root_gets_few_bins(spark, monkeypatch):
    """Many bins over half full and one residual that could go into any of them; then a corpus sorted by length."""
    seen, stored = [], packing.stored

    def counted(df, name, *more):
        out = stored(df, name, *more)
        if name.startswith("level"):
            seen.extend(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        return out

    monkeypatch.setattr(packing, "stored", counted)
    rows = spark.range(6401).select(F.col("id").alias("k"), F.when(F.col("id") == 0, 500).otherwise(3000).cast("long").alias("length"))
    got = packing.pack(rows, 4096).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert len(got) == 6400 and all(r.n == r.end <= 4096 for r in got)
    assert max(seen) <= packing.FAN * packing.OPEN
    lengths = spark.range(3000, numPartitions=40).select(F.col("id").alias("k"), F.when(F.col("id") < 1500, 30 + F.col("id") % 20).otherwise(50 + F.col("id") % 20).alias("length"))
    fills = packing.pack(lengths, 100).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    total = sum(r.n for r in fills)
    assert len(fills) <= 1.05 * total / 100 and max(r.n for r in fills) <= 100


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(packing, "word_hashes", lambda data, starts, stops: (data[starts] % 2).astype(np.uint64))
    words = packing.WordIds(WORD_BPE)
    texts = ["one two three one six", "seven one", "", "two"]
    raw = [t.encode() for t in texts]
    ids, begin = words.ids(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    tokenizer = tokenizers.Tokenizer.from_file(WORD_BPE)
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_come_whole(spark):
    got = packing.tokenised(docs(spark, [(1, "one two three " * 30)]), WORD_BPE, 64, with_ids=True).orderBy("piece").collect()
    ids = np.frombuffer(b"".join(bytes(r.ids) for r in got), "<u4").tolist()
    assert ids == [*tokenizers.Tokenizer.from_file(WORD_BPE).encode("one two three " * 30, add_special_tokens=False).ids, 1]


# --- token counts ---------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [1, 2, 32])
def test_counts_follow_edits(monkeypatch, chunk):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    count = token_counts.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(3 + chunk)
    some = ["word", " ", "  ", "\n", "é", "9", "'s", "'", " the", ".", "😀", "中文", "。", "e\u0301", "²", "\u00a0", "12", "ll"]
    for trial in range(60):
        text = "".join(rng.choices(some, k=rng.randint(0, 200)))
        counted = token_counts.CountedText(text, count, rng.choice([1, 20]))
        for _ in range(6):
            now, edits, at = counted.text, [], 0
            while at <= len(now) and rng.random() < 0.7:
                a = rng.randint(at, min(len(now), at + 40))
                at = min(len(now), a + rng.choice([0, 1, 3, 30]))
                edits.append((a, at, "".join(rng.choices([*some, ""], k=rng.randint(0, 3)))))
            want, at = "", 0
            for a, b, new in edits:
                want, at = want + now[at:a] + new, b
            want += now[at:]
            counted.edit(edits)
            assert counted.text == want and counted.tree.total == count(want) and len(counted) == len(want), trial
            parts = [want[p:q] for p, q in zip(counted.starts, [*counted.starts[1:], len(want)], strict=True)]
            assert counted.leaves() == [count(p) for p in parts] and "".join(parts) == want


def test_an_edit_encodes_little():
    seen = []
    counted = token_counts.CountedText("some words here " * 2000, lambda t: seen.append(len(t)) or len(t.split()), 100)
    seen.clear()
    counted.edit([(5000, 5005, "other")])
    assert sum(seen) < 400 and counted.tree.total == len(counted.text.split())
    chinese = token_counts.CountedText("没有空格的文字，" * 2000, lambda t: seen.append(len(t)) or len(t), 100)
    seen.clear()
    chinese.edit([(5000, 5001, "字")])
    assert sum(seen) < 400


def test_many_edits_take_little_time():
    text = "word " * 40_000
    counted = token_counts.CountedText(text, lambda t: len(t.split()))
    began = time.time()
    counted.edit([(k, k + 4, "other") for k in range(0, 100_000, 5)])
    assert time.time() - began < 2 and counted.tree.total == 40_000 and counted.encoded < 3 * len(text)
    began = time.time()
    for k in range(3000):  # one by one, all over the text
        counted.edit([(k * 61 % 180_000, k * 61 % 180_000 + 1, "x y")])
    assert time.time() - began < 3 and len(counted) == len(counted.text)


def test_overlapping_edits_are_refused():
    for edits in ([(0, 3, "a"), (2, 4, "b")], [(3, 2, "")], [(0, 99, "")], [(5, 6, "x"), (1, 2, "y")]):
        with pytest.raises(ValueError, match="overlaps"):
            token_counts.CountedText("one two three", len).edit(edits)


def test_counts_of_a_table(spark):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    count = token_counts.counter(ranks)
    rows = [(1, "call 555123 or a@b.com now"), (2, None), (3, ""), (None, "plain"), (3, ""), (4, "5551 " * 20000)]
    got = sorted(token_counts.edited_counts(docs(spark, rows), ranks, token_counts.mask_edits).collect(), key=lambda r: repr(r.doc_id))
    want = sorted(rows, key=lambda r: repr(r[0]))
    for r, (i, t) in zip(got, want, strict=True):
        masked = token_counts.MASKED.sub(token_counts.MASK, t or "")
        assert (r.doc_id, r.n_tokens, r.n_tokens_after, r.n_edits) == (i, count(t or ""), count(masked), len(token_counts.MASKED.findall(t or "")))
        assert r.tree[1] == r.n_tokens_after
    given = spark.createDataFrame([(1, "a b c", [(0, 1, "xyz"), (4, 5, None)]), (2, "a", None)], "doc_id long, text string, edits array<struct<start: int, end: int, replacement: string>>")
    assert [(r.n_edits, r.n_tokens_after) for r in token_counts.edited_counts(given, ranks).orderBy("doc_id").collect()] == [(2, count("xyz b ")), (0, count("a"))]
    assert token_counts.edited_counts(docs(spark, []), ranks).count() == 0


# --- the pipeline ---------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r for r in table.collect()}
    columns = table.dtypes
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        table = spark.createDataFrame(stage(spark, table, sf).collect(), table.schema)
        now = {r.doc_id: r for r in table.collect()}
        assert table.dtypes == columns and set(now) <= set(kept) and len(now) == table.count(), name
        if k == 2:
            assert set(now) == set(kept) and all(len(r.text) <= len(kept[i].text) and r.n_chars == len(r.text) for i, r in now.items())
        else:
            assert all(r == kept[i] for i, r in now.items())
        kept = now
    last = corpus_pipeline.STAGES[-1][1](spark, table, sf).collect()
    assert {r.doc_id for r in last} == set(kept)
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(last)


def brute_pipeline(kept, column, items):
    """Texts after the stages that follow toxicity, by id, from plain Python; kept: (id, text) after toxicity."""
    from test_dedup import brute_classes, brute_hits

    classes = brute_classes(kept, 5, 80)
    alone = [(i, t) for i, t in kept if classes[i][1] == i]
    first = {}
    for i, t in alone:
        b = t.encode()
        for p in range(len(b) - 99):
            first[b[p : p + 100]] = min(first.get(b[p : p + 100], (i, p)), (i, p))
    cut = []
    for i, t in alone:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] != (i, p):
                gone[p : p + 100] = True
        cut.append((i, np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")))
    hit = {i for i, *_, bad in brute_hits(cut, items, 10) if bad}
    clean = [(i, t) for i, t in cut if i not in hit]
    return [alone, cut, clean]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline_is_that_of_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    scored = {r.doc_id: r.predicted for r in queries.QUERIES["op3_toxicity"](spark, sf).collect()}
    want = [sorted((r.doc_id, r.text) for r in table.collect() if not scored[r.doc_id])]
    want += brute_pipeline(want[0], None, items)
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        table = spark.createDataFrame(stage(spark, table, sf).collect(), table.schema)
        assert sorted((r.doc_id, r.text) for r in table.collect()) == rows, name
    tokenizer = tokenizers.Tokenizer.from_file(WORD_BPE)
    lengths = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in want[-1]}
    got = corpus_pipeline.STAGES[-1][1](spark, table, sf).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == lengths


def test_pipeline_of_empty_and_odd_tables(spark):
    sf = "/root/testdata/sf0.001"
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, raw string, node long, key long, bin long, text_ string"
    rows = [(None, None, None, None, None, "r", "x", 1, 2, 3, "t"), (None, "", None, "s", 0, "r", "x", 1, 2, 3, "t"), (5, "few words here", "en", "s", 14, "r", "x", 1, 2, 3, "t"), (None, "word " * 300, "en", "s", 1500, "r", "x", 1, 2, 3, "t")]
    for data in ([], rows):
        table = spark.createDataFrame(data, kind)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, sf)
            assert got.count() == len(data), name
            assert name == "packing" or got.dtypes == table.dtypes, name


def test_pipeline_keeps_nulls(spark):
    table = docs(spark, [(1, None), (2, ""), (None, "a few words"), (3, " ".join(f"word{k}" for k in range(90)))]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        got = stage(spark, table, "/root/testdata/sf0.001")
        assert got.dtypes == table.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, table.collect()))


def test_every_operator_is_registered():
    names = list(queries.QUERIES)
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_record_batches_with_offsets():
    from roadloom.llm.common import steps

    column = pa.array([b"ab", b"", b"cdef", b"g"], pa.binary()).slice(1)
    assert [(i, j, bytes(d), o.tolist()) for i, j, d, o in steps(column, 4)] == [(0, 2, b"cdef", [0, 0, 4]), (2, 3, b"g", [0, 1])]
