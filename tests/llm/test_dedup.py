"""Exact dedup, repeated windows and the Jaccard join against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import exact_dedup, ngram_join, suffix_dedup, wordbpe

SCHEMA = "doc_id long, text string, digest string, keep_id long, block string, gid long"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 7, "y", 9) for i, t in rows], SCHEMA).repartition(3)


def words(rng, n, of=300):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


# ---- exact dedup


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def test_exact(spark):
    rows = [(1, "Abc É"), (2, "abc É"), (3, "abc é"), (4, None), (5, ""), (6, "long " * 50_000), (9, "LONG " * 50_000), (7, "one"), (7, "one"), (None, "abc é"), *[(100 + i, "Hot") for i in range(60)]]
    found = [r.asDict() for r in exact_dedup.deduplicate(frame(spark, rows)).collect()]
    assert len(found) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(lower(t).encode()).hexdigest()].append(i)
    for r in found:
        own = groups[r["text_sha256"]]
        assert r["keep_id"] == max(x for x in own if x is not None) and r["group_size"] == len(own)
    assert sum(r["kept"] for r in found) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])
    kept = exact_dedup.keep_distinct(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(groups)


def test_index_remembers(spark):
    index = exact_dedup.DigestIndex(spark)
    first = exact_dedup.deduplicate(frame(spark, [(1, "a"), (2, "b"), (3, "A")]), index).collect()
    assert {(r["doc_id"], r["kept"]) for r in first} == {(1, False), (2, True), (3, True)}
    second = exact_dedup.deduplicate(frame(spark, [(7, "a"), (8, "c"), (9, "c")]), exact_dedup.DigestIndex(spark, index.path)).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in second} == {(7, 3, False), (8, 9, False), (9, 9, True)}
    assert index.rows().count() == 3


def answer(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_repeated_batch(spark):
    """The same batch again, after a failure further on, gets its first answer."""
    index = exact_dedup.DigestIndex(spark)
    one, two = frame(spark, [(1, "a"), (2, "b"), (3, "A")]), frame(spark, [(7, "a"), (8, "c"), (9, "c")])
    first = answer(exact_dedup.deduplicate(one, index))
    assert answer(exact_dedup.deduplicate(one.repartition(2), index)) == first
    second = answer(exact_dedup.deduplicate(two, index, batch="two"))
    assert answer(exact_dedup.deduplicate(two, index, batch="two")) == second
    assert answer(exact_dedup.deduplicate(one, index)) == first
    assert sorted(r["kept"] for r in exact_dedup.deduplicate(two, index, batch="three").collect()) == [False] * 3
    assert index.rows().count() == 3
    assert exact_dedup.keep_distinct(frame(spark, [(None, "z"), (None, "z"), (4, "y"), (4, "y")]), index).count() == 2


def test_index_keeps_its_buckets(spark):
    index = exact_dedup.DigestIndex(spark, buckets=2)
    exact_dedup.deduplicate(frame(spark, [(1, "a"), (2, "b"), (3, "c")]), index)
    spark.sql(f"DROP TABLE {index.table}")  # as in a new session
    with pytest.raises(ValueError, match="2 buckets"):
        exact_dedup.DigestIndex(spark, index.path, buckets=5)
    again = exact_dedup.DigestIndex(spark, index.path)
    found = exact_dedup.deduplicate(frame(spark, [(7, "a"), (8, "B"), (9, "d")]), again).collect()
    assert again.buckets == 2 and {(r["doc_id"], r["kept"]) for r in found} == {(7, False), (8, False), (9, True)}
    assert again.rows().count() == again.rows().distinct().count() == 4


def test_exact_empty(spark):
    assert exact_dedup.deduplicate(frame(spark, [])).count() == 0


# ---- repeated windows


def brute_windows(rows, size):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        key = (1 << 63) - 1 if i is None else i
        for a in range(len(data) - size + 1):
            w = data[a : a + size]
            first[w] = min(first.get(w, key), key)
    out = []
    for i, t in rows:
        data, key = (t or "").encode(), (1 << 63) - 1 if i is None else i
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - size + 1):
            if first[data[a : a + size]] < key:
                gone[a : a + size] = True
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def window_rows(seed=5):
    rng = random.Random(seed)
    passage, other = " ".join(words(rng, 40)), " ".join(words(rng, 25))
    rows = []
    for i in range(60):
        parts = words(rng, rng.randrange(0, 120))
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), passage)
        if i % 4 == 0:
            parts.insert(rng.randrange(len(parts) + 1), other + " " + other)
        rows.append((i * 7 % 61, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, rows[3][1] + " tail"), (203, None), (204, ""), (205, "x" * 700), (206, "x" * 300 + "y"), (207, "é" * 90), (208, "é" * 80 + "z"), (None, passage), (210, passage), (210, "a" + passage), (211, "q" * 49), (212, "q" * 49), (213, "ab" * 300), (214, "ba" * 40)]
    return rows


@pytest.mark.parametrize(("size", "hot"), [(16, 20_000), (50, 20_000), (50, 3), (57, 0)])
def test_windows(spark, size, hot, monkeypatch):
    """In blocks and chunks shorter than some texts; with and without second digits."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 250)
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    rows = window_rows()
    found = suffix_dedup.remove_repeats(frame(spark, rows), size).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_windows(rows, size)


def test_windows_keep_characters(spark):
    found = suffix_dedup.remove_repeats(frame(spark, [(1, "é" * 60), (2, "x" + "é" * 50 + "y"), (3, "free text")]), 51, with_text=True)
    assert {r["doc_id"]: r["kept"] for r in found.collect()} == {1: "é" * 60, 2: "xy", 3: "free text"}


def test_long_text():
    """A text of many chunks takes memory for one chunk and its runs."""
    import tracemalloc

    buf = np.random.default_rng(3).integers(97, 123, 24 << 20).astype(np.uint8)
    tracemalloc.start()
    _, starts, number = suffix_dedup.runs(buf, np.array([0]), np.array([len(buf)]), 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert number.sum() == len(buf) - 49 and np.array_equal(starts[1:], (starts + number)[:-1]) and peak < 8 * len(buf)


def test_windows_empty(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(frame(spark, []), 8)


def test_masks_in_portions():
    rng, size = random.Random(5), 20
    source = rng.randbytes(3000)
    texts, owner = [], []
    for _ in range(300):
        at, n = rng.randrange(2900), size + rng.randrange(suffix_dedup.RUN)
        texts.append(source[at : at + n][: size + suffix_dedup.RUN - 1])
        owner.append(rng.randrange(40))
    digits = np.array([rng.randrange(3) for _ in texts], np.uint64)
    least = {}
    for text, digit, who in zip(texts, digits.tolist(), owner, strict=True):
        for k in range(len(text) - size + 1):
            key = (digit, text[k : k + size])
            least[key] = min(who, least.get(key, who))
    expected = [sum((least[(d, t[k : k + size])] < o) << k for k in range(len(t) - size + 1)) for t, d, o in zip(texts, digits.tolist(), owner, strict=True)]
    for portion in (1, 700, 1 << 20):
        assert suffix_dedup.repeated(texts, digits, np.array(owner), size, portion).tolist() == expected


def test_digit_passes_equal_sorting():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = np.arange(0, 3900)
    alive, heads = suffix_dedup.equal_groups(buf, starts, np.zeros(len(starts), np.int64), 18)
    groups = defaultdict(set)
    for s in starts:
        groups[buf[s : s + 18].tobytes()].add(int(s))
    assert {frozenset(starts[g].tolist()) for g in np.split(alive, heads[1:])} == {frozenset(g) for g in groups.values() if len(g) > 1}


# ---- Jaccard join


def shingle_set(text, n):
    own = lower(text).encode().split()
    if not own:
        return frozenset()
    return frozenset(tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1)))


def brute_links(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(lambda: 1 << 62)
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least[root(k)], i)
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


def link_rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for g in range(14):
        base = words(rng, rng.choice([3, 5, 8, 10, 30, 60, 150, 400, 900]), 5000)
        for _ in range(rng.randrange(1, 7)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                own += words(rng, max(1, len(own) // 14), 9000)
            rows.append((" ".join(own).replace("w", "W" if rng.random() < 0.5 else "w"),))
    # a chain in which only neighbours are linked
    chain = words(rng, 200, 10**6)
    for k in range(12):
        rows.append((" ".join(chain[k * 6 : k * 6 + 120]),))
    rows += [("a b c d e f g",), ("a b c d e f g h",), ("one two",), ("ONE\ttwo",), ("one two three",), (None,), ("",), (" \n",), ("z " * 3000,), ("é è",)]
    rng.shuffle(rows)
    return [(k * 13 % 997, t) for k, (t,) in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_links(spark, n, percent):
    rows = link_rows()
    found = ngram_join.link(frame(spark, rows), n, percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_links(rows, n, percent)


def test_links_empty(spark):
    assert ngram_join.link(frame(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.link(frame(spark, [(4, None)])).collect()] == [(4, 0, 4)]


def lanes(rng, n):
    return rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(2)
    for percent in (80, 85):
        bands = ngram_join.Bands(percent)
        for _ in range(300):
            n = int(rng.integers(2, 400))
            both = lanes(rng, n)
            extra = int(n * (100 - percent) / percent)
            k = int(rng.integers(0, extra + 1))
            a, b = (ngram_join.as_set(np.concatenate([both, lanes(rng, m)], axis=1)) for m in (k, extra - k))
            if not ngram_join.similar(a, b, percent) or np.array_equal(a, b):
                continue
            keys = [set(np.concatenate([ngram_join.part_keys(x[0], *lv) for lv in bands.levels(x.shape[1])]).tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


def test_hamming_distance_is_a_lower_bound():
    rng = np.random.default_rng(4)
    a, b = (ngram_join.as_set(lanes(rng, 500)) for _ in range(2))
    b = ngram_join.as_set(np.concatenate([a[:, :400], b[:, :60]], axis=1))
    words = np.zeros((2, 40), np.uint64)
    for row, own in zip(words, (a, b), strict=True):
        where, parity, _ = ngram_join.sketch(own[0], 3, 40)
        row[where.astype(int)] = parity
    distance, differ = int(np.bitwise_count(words[0] ^ words[1]).sum()), a.shape[1] + b.shape[1] - 2 * ngram_join.in_both(a, b)
    assert 0 < distance <= differ == len(np.setxor1d(a[0], b[0]))
    for bits in (64, 512, 4096):
        x, y = ngram_join.bit_sketches([a, b], bits)
        assert 0 < int(np.bitwise_count(x ^ y).sum()) <= differ


def test_half_of_the_bits_is_not_enough():
    a = np.array([[5, 5, 7, 7, 9], [2, 1, 3, 3, 4]], np.uint64)
    b = np.array([[5, 7, 9], [3, 3, 8]], np.uint64)
    assert ngram_join.as_set(a).tolist() == [[5, 5, 7, 9], [1, 2, 3, 4]]
    assert ngram_join.in_both(ngram_join.as_set(a), b) == ngram_join.in_both(b, ngram_join.as_set(a)) == 1


def test_word_hashes():
    """The published 128-bit value of SipHash-2-4 for the bytes 0 to 14, and any length."""
    key = bytes(range(16))
    lanes_of = lambda data, at, sizes: ngram_join.word_lanes(np.frombuffer(data, np.uint8), np.array(at), np.array(sizes), key).T
    assert lanes_of(b"", [0], [0]).tobytes() == bytes.fromhex("a3817f04ba25a8e66df67214c7550293")
    data = np.random.default_rng(0).bytes(4000)
    at, sizes = [7 * i for i in range(300)], list(range(300))
    each = [lanes_of(data[a : a + n], [0], [n]).tobytes() for a, n in zip(at, sizes, strict=True)]
    assert lanes_of(data, at, sizes).tobytes() == b"".join(each) and len(set(each)) == 300


def test_words_of_one_hash(spark):
    """Two words that the sorting hash can't tell apart are still two words."""
    one, two = "qwertyuiasdfghjk", "vserzagennzspoph"
    buf = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    h = wordbpe.hash_spans(buf, np.array([0, 17]), np.array([16, 16]))
    assert h[0] == h[1] and len(wordbpe.distinct_spans(buf, np.array([0, 17]), np.array([16, 16]))[1]) == 2
    rows = [(1, f"a b {one} d e"), (2, f"a b {two} d e"), (3, one), (4, two)]
    found = ngram_join.link(frame(spark, rows), 4, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text + " x"), (7, text + " y"), (7, "other words here"), (7, text + " y"), (None, "lonely text only"), (None, "lonely text only"), (None, ""), (None, "")]
    found = ngram_join.link(frame(spark, rows), 4, 85, with_rows=True).collect()
    by_text = defaultdict(set)
    for r in found:
        by_text[r["text_id"]].add((r["doc_id"], r["component_id"]))
    key = lambda t: hashlib.sha256(t.encode()).digest()[:16]
    assert by_text[key(text)] == by_text[key(text + " x")] == {(None, 7)} and by_text[key("lonely text only")] == {(None, None)}
    stays = [r["text_id"] for r in found if r["stays"]]
    assert sorted(map(bytes, stays)) == sorted(map(key, [text + " y", "other words here", "lonely text only", "", ""]))


def test_one_group_of_many(spark):
    """Thousands of near copies of one text, hubs and outliers in one group."""
    rng = random.Random(9)
    base = words(rng, 80, 10**6)
    rows = []
    for i in range(1500):
        own = list(base)
        for _ in range(rng.choice([1, 1, 2, 5])):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link(frame(spark, rows), 4, 85).collect()) == brute_links(rows, 4, 85)


@pytest.mark.parametrize("most", [500_000, 5])
def test_components(spark, most, monkeypatch):
    monkeypatch.setattr(ngram_join, "EDGES_PER_TASK", most)
    order = list(range(41))
    random.Random(8).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    found = {r["node"]: r["label"] for r in ngram_join.components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    hub = spark.createDataFrame([(0 if i % 3 else i - 1, i) for i in range(1, 300)] + [(900, 800)], "a long, b long")
    assert {r["node"]: r["label"] for r in ngram_join.components(hub).collect()} == dict.fromkeys(range(300), 0) | {800: 800, 900: 800}
    assert ngram_join.components(edges.where(F.lit(False))).count() == 0
