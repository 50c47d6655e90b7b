"""Repeated substrings, near duplicates and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from roadloom.llm import decontaminate as D
from roadloom.llm import common, induced_sort, near_dup, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, raw string, key long, node long"


def docs(spark, rows):
    """Rows (id, text) with further columns, some of names that operators use inside."""
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x", None, 1, 2) for i, t in rows], DOCS)


# --- external induced sorting ---------------------------------------------------------------------


@pytest.mark.parametrize(("waiting", "step", "base", "runs"), [(1 << 13, 1 << 16, 1 << 14, 48), (8, 16, 2, 3), (4, 5, 1, 2)])
@pytest.mark.parametrize("budget", [40, 300, 10**7])
@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_induced_sort_is_the_suffix_order(monkeypatch, budget, dtype, waiting, step, base, runs):
    for name, value in (("WAITING", waiting), ("STEP", step), ("BASE", base), ("MOST_RUNS", runs)):
        monkeypatch.setattr(induced_sort, name, value)
    monkeypatch.setattr(induced_sort._chunks, "__defaults__", (step * 4,))
    rng = np.random.default_rng(budget)
    for _ in range(80):
        n, k, depth = int(rng.integers(1, 100)), int(rng.integers(1, 8)), int(rng.choice([3, 9, 100]))
        t = rng.integers(0, k, n).astype(dtype)
        t = np.tile(t, 3) if rng.random() < 0.3 else t
        parts = list(induced_sort.induced(t, depth, budget))
        pos, above = np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])
        assert sorted(pos.tolist()) == list(range(len(t)))
        cut = [tuple(t[i : i + depth].tolist()) for i in pos.tolist()]
        for a, b, c in zip(cut[:-1], cut[1:], above[1:].tolist(), strict=True):
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert a >= b and c == same


def test_a_usual_shard_spills_and_recurses():
    """At the shipped settings, on a shard of the usual size with many repeats: order checked on a sample of neighbours."""
    rng = np.random.default_rng(5)
    t = rng.integers(97, 110, suffix_dedup.SHARD_SYMBOLS // 2).astype(np.uint8)
    t = np.concatenate([t, *[t[k : k + 200] for k in rng.integers(0, len(t) - 200, len(t) // 200)]])
    counters, n, last = induced_sort.Counters(), 0, None
    for pos, above in induced_sort.induced(t, suffix_dedup.LENGTH, suffix_dedup.BUDGET, counters):
        n += len(pos)
        for k in range(1, len(pos), 1009):
            a, b = (t[p : p + suffix_dedup.LENGTH].tobytes() for p in pos[k - 1 : k + 1])
            assert a >= b and a[: above[k]] == b[: above[k]] and (above[k] == suffix_dedup.LENGTH or a[: above[k] + 1] != b[: above[k] + 1])
        if last is not None and len(pos):
            assert t[last : last + 100].tobytes() >= t[pos[0] : pos[0] + 100].tobytes()
        last = pos[-1] if len(pos) else last
    assert n == len(t) and counters.levels >= 2 and counters.spilled > 0 and counters.mapped > 0


def test_queue_keeps_the_order_of_arrival(monkeypatch):
    monkeypatch.setattr(induced_sort, "WAITING", 64)
    counters = induced_sort.Counters()
    queue = induced_sort.Queue(2000, np.int64, counters)
    for i in range(200):
        queue.push(np.repeat([0, 1, 2], [0, 10, 5]) if i % 2 else np.repeat([0, 2], 5), np.arange(i * 20, i * 20 + (15 if i % 2 else 10)), np.full(15 if i % 2 else 10, i % 7, np.uint8))
        if i == 100:
            queue.settle()
    assert counters.spilled
    got = [np.concatenate([p for p, _ in queue.stream(s)]).tolist() if s != 1 else queue.take(1, 2)[1].tolist() for s in range(3)]
    assert all(g == sorted(g) for g in got) and [len(g) for g in got] == [500, 1000, 1000]


# --- repeated substrings --------------------------------------------------------------------------


def brute_repeats(rows):
    """Every byte of a 100-byte string that also starts earlier, by a dictionary of all strings."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 99):
            place = (suffix_dedup.FIRST_ID if i is None else i, p)
            first[b[p : p + 100]] = min(first.get(b[p : p + 100], place), place)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] != (suffix_dedup.FIRST_ID if i is None else i, p):
                gone[p : p + 100] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeat_rows():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(200)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    shared, line = text(40), "=" * 700
    rows = [(k, text(rng.randint(0, 90))) for k in range(30)]
    rows += [(30 + k, text(20) + " " + shared + " " + text(15)) for k in range(8)]
    rows += [(40, shared), (41, shared), (42, shared * 4), (43, line), (44, line + "x" + line), (45, "ab" * 400), (46, None), (47, ""), (48, "é" * 60), (49, text(9000)), (50, "a" * 99), (51, "a" * 100), (52, "a" * 100)]
    edited = shared[:60] + "?" + shared[61:]
    return rows + [(60, edited), (61, edited), (53, rows[49][1] if rows[49][1] else "")]


@pytest.mark.parametrize(("budget", "symbols"), [(suffix_dedup.BUDGET, suffix_dedup.SHARD_SYMBOLS), (3000, 500), (200, 10**6)])
def test_repeats_are_those_of_brute_force(spark, budget, symbols):
    rows = repeat_rows()
    got = suffix_dedup.remove_repeats(docs(spark, rows).repartition(3), budget=budget, symbols=symbols).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute_repeats(rows)


def test_repeats_of_every_period_are_removed(spark):
    """One stretch of each period from 1 to 200 bytes, alone and copied, so that a repeat may stand inside one piece only."""
    rng = random.Random(77)
    rows = []
    for period in range(1, 201):
        unit = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=period))
        stretch = (unit * (3 + 400 // period))[: 2 * period + 250]
        rows.append((period, stretch))
        if period % 7 == 0:
            rows.append((1000 + period, stretch))
    got = suffix_dedup.remove_repeats(docs(spark, rows).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute_repeats(rows)


def test_repeats_of_shared_ids_and_null_ids(spark):
    a, b = "q" * 50 + "w" * 80, "r" * 120 + "t" * 30
    rows = [(1, a), (1, a), (1, b), (2, b), (None, a + "z"), (3, a)]
    got = suffix_dedup.remove_repeats(docs(spark, rows), carry=["doc", "key"]).collect()
    assert all((r.row.doc, r.row.key) == ("x", 1) for r in got)
    removed = {(r.doc_id, r.n_bytes): r.n_removed for r in got}
    assert len(got) == 6 and removed == {(1, 130): 130, (1, 150): 119, (2, 150): 150, (None, 131): 0, (3, 130): 130}


def test_repeats_of_many_null_ids(spark):
    """All rows are one id: texts are told apart by their full hash."""
    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    shared = " ".join(rng.choices(words, k=25))
    rows = []
    for k in range(3000):
        own = " ".join(rng.choices(words, k=rng.randint(0, 30)))
        rows.append((None if k % 10 else 7, own[: rng.randint(0, 80)] + shared + own if k % 3 == 0 else own))
    rows += rows[:50]
    got = suffix_dedup.remove_repeats(docs(spark, rows).repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute_repeats(rows)


def test_repeats_keep_whole_characters_and_nulls(spark):
    a = "ä" * 80
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(spark, [(1, "x" + a), (2, a + "yé"), (3, None)])).collect()}
    assert got[3].kept_text is None and got[3].n_bytes == 0
    assert got[2].kept_text.endswith("yé")


def test_repeats_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


# --- near duplicates ------------------------------------------------------------------------------


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_classes(rows, k, percent):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, k)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_are_those_of_brute_force(spark, k, percent):
    rng = random.Random(9)
    words = [f"w{n}" for n in range(400)]
    base = rng.choices(words, k=120)
    rows = [(100 + n, " ".join(rng.choices(words, k=rng.randint(1, 90)))) for n in range(40)]
    for n in range(60):  # variants of one text at all similarities, so that links form chains
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((n, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "two one"), (207, " ".join(base).upper()), (208, "\x1f"), (209, "x " * 30000)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs(spark, rows).repartition(3), k, percent).collect()}
    want = brute_classes(rows, k, percent)
    assert {i: g[:2] for i, g in got.items()} == want
    assert all(g[2] == (i == g[1]) for i, g in got.items())


@pytest.mark.parametrize("ids", [near_dup.BROADCAST_IDS, 0])
def test_near_duplicates_in_small_blocks_and_by_a_shuffled_join(spark, monkeypatch, ids):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", ids)
    rng = random.Random(19)
    words = [f"w{n}" for n in range(300)]
    rows = []
    for family in range(3):
        base = rng.choices(words, k=90)
        for n in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((100 * family + n, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs(spark, rows).repartition(3), 3, 85).collect()}
    assert got == brute_classes(rows, 3, 85)


@pytest.mark.parametrize("similarity", [0.85, 0.9])
def test_recall_of_planted_links(similarity):
    """Pairs of sets of a given similarity: each is a candidate, that is, a chunk agrees in all symbols but one."""
    rng = np.random.default_rng(int(100 * similarity))
    found = pairs = 0
    for _ in range(40):
        sets = []
        for _ in range(100):
            n = int(rng.integers(40, 400))
            both = round(2 * n * similarity / (1 + similarity))
            common, own = rng.integers(0, 1 << 63, both, dtype=np.uint64), rng.integers(0, 1 << 63, 2 * (n - both), dtype=np.uint64)
            sets += [np.concatenate([common, own[: n - both]]), np.concatenate([common, own[n - both :]])]
        begin = np.cumsum([0, *map(len, sets)])
        sig = near_dup.signatures(np.concatenate(sets), begin).reshape(100, 2, near_dup.CHUNKS, near_dup.SYMBOLS)
        found += int(((sig[:, 0] != sig[:, 1]).sum(axis=2) <= near_dup.ERRORS).any(axis=1).sum())
        pairs += 100
    assert found == pairs


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "z y x w"), (2, "a b c d"), (None, None)]
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id), r.kept) for r in near_dup.near_duplicates(docs(spark, rows), 3, 85).collect())
    assert got == sorted([("1", 2, "1", True), ("1", 2, "1", True), ("None", 2, "1", False), ("None", 2, "None", False), ("2", 2, "1", False), ("None", 0, "None", False)])
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("few", [0, None])
def test_components_are_those_of_brute_force(spark, few):
    rng = random.Random(5)
    edges = [(rng.randrange(10**9, 10**9 + 400), rng.randrange(10**9, 10**9 + 400)) for _ in range(300)]  # trees, rings, loops, repeats
    edges += [(-k, -k - 1) for k in range(1, 300)] + [(5000 - k, 5001) for k in range(200)]  # a path, a hub with the largest id
    edges += [(10**6 + min(k, (k * 37) % 256), 10**6 + (k * 37) % 256) for k in range(256)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b", few=few).collect()
    assert sorted(map(tuple, got)) == sorted((x, top(x)) for x in linked)
    assert common.components(spark.createDataFrame([(1, 1)], "a long, b long"), "a", "b", few=few).collect() == []


def test_components_of_few_edges_take_few_tasks(spark):
    """Each task costs the driver memory; rounds of 64 partitions took thousands."""
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("few edges", "")
    try:
        got = common.components(spark.createDataFrame([(k, k + 1) for k in range(100)], "a long, b long"), "a", "b").collect()
        stages = {s for j in sc.statusTracker().getJobIdsForGroup("few edges") for s in sc.statusTracker().getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(sc.statusTracker().getStageInfo, stages) if i)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.label for r in got} == {0} and len(got) == 101
    assert 64 < tasks < 300


def test_parity_bitmaps_never_overstate(spark):
    rng = np.random.default_rng(3)
    for _ in range(200):
        common = rng.integers(0, 1 << 63, int(rng.integers(0, 300)), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, int(rng.integers(1, 60)), dtype=np.uint64)])) for _ in range(2))
        x, y = (np.frombuffer(near_dup.parity(s), np.uint64) for s in (a, b))
        w = min(len(x), len(y))
        differ = int(np.bitwise_count(near_dup._folded([x], w)[0] ^ near_dup._folded([y], w)[0]).sum())
        assert differ <= len(np.setxor1d(a, b))


# --- benchmark passages ---------------------------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(rows, items, n):
    windows = {}
    for name, t in items:
        w = words(t)
        for a in range(max(1, len(w) - n + 1)) if w and name is not None else ():
            windows.setdefault(tuple(w[a : a + n]), set()).add(str(name))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if owners := windows.get(tuple(w[a : a + size])):
                    hit |= set(range(a, a + size))
                    found |= owners
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def passages():
    rng = random.Random(12)
    vocabulary = ["the", "of", "Über", "naïve", "x1", *(f"w{n}" for n in range(60))]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(f"i{k}", text(rng.randint(8, 30))) for k in range(20)] + [("i3", text(14)), ("short", "only three words"), ("none", None), ("blank", " .,- "), (None, text(20)), ("same", None), ("the", "the the the the the the the the the the the")]
    rows = [(k, text(rng.randint(0, 60))) for k in range(40)]
    rows += [(50 + k, text(10) + ". " + items[k][1].upper() + "; " + text(5)) for k in range(15)]
    rows += [(70, None), (71, ""), (72, "...only-THREE/words..."), (73, "the " * 3000), (73, "the " * 12), (None, items[2][1]), (74, " ".join(items[5][1].split()[:10])), (75, " ".join(items[5][1].split()[:7]))]
    return rows, items


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, 7, "z") for i, t in items], "item_id string, text string, doc_id long, shard string")


@pytest.mark.parametrize(("block", "places"), [(D.BLOCK_WORDS, D.PLACES), (60, 5), (7, 100)])
def test_passages_are_those_of_brute_force(spark, monkeypatch, block, places):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    monkeypatch.setattr(D, "PLACES", places)
    rows, items = passages()
    got = D.decontaminate(docs(spark, rows).repartition(3), benchmark(spark, items)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=repr) == brute_hits(rows, items, 10)


def test_passages_of_empty_tables(spark):
    rows, items = passages()
    assert D.decontaminate(docs(spark, []), benchmark(spark, items)).count() == 0
    assert {r.contaminated for r in D.decontaminate(docs(spark, rows), benchmark(spark, [])).collect()} == {False}


def brute_near(rows, items, n, slop):
    windows = {}
    for name, t in items:
        w = words(t)
        for a in range(max(1, len(w) - n + 1)) if w and name is not None else ():
            windows.setdefault(tuple(w[a : a + n]), set()).add(str(name))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for window, owners in windows.items():
            need, span = set(window), len(window) + slop
            for a in range(len(w)) if need <= set(w) else ():
                if need <= set(w[a : a + span]):
                    hit |= set(range(a, min(len(w), a + span)))
                    found |= owners
        out.append((i, len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [D.BLOCK_WORDS, 40])
def test_proximity_is_that_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    monkeypatch.setattr(D, "PLACES", 50)
    rows, items = passages()
    rng = random.Random(5)
    near = []
    for k in range(12):  # windows with words moved and others put between
        w = items[k][1].split()[:10]
        rng.shuffle(w)
        near.append((200 + k, "zz " * 7 + " ".join(x + " yy" * (rng.random() < 0.3) for x in w) + " zz" * rng.randint(0, 9)))
    rows = [r for r in rows if r[0] != 73] + near + [(73, "the " * 40)]
    got = D.decontaminate(docs(spark, rows).repartition(3), benchmark(spark, items)).collect()
    assert sorted(((r.doc_id, r.n_near, r.near_items) for r in got), key=repr) == brute_near(rows, items, 10, D.SLOP)
    assert any(r.n_near and not r.n_hit for r in got)


def test_proximity_finds_words_in_any_order(spark):
    item = [("p", "alpha beta gamma")]
    rows = [(1, "gamma then beta alpha"), (2, "alpha x x x beta gamma"), (3, "alpha beta"), (4, "beta gamma alpha")]
    got = {r.doc_id: r.n_near > 0 for r in D.decontaminate(docs(spark, rows), benchmark(spark, item), window=3, slop=1).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}
