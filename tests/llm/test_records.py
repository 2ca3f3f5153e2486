"""Archives, token files, packing, language ID, pieces and media."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import langid, media, packing, sentencepiece, skew, token_scan, token_store, warc, wordbpe
from cairn.llm.common import shared_dir, values

ODD = [
    "", "it's we're don't  'sx ''s x's9 'll'd 12a3--'s!", "ÀÉÎ ß ǅ", "İx Ωσς ﬁ é", "a<|endoftext|>b", "x\x00y z«q» ×÷", None, "'", "''", "'re", "l'été n'est", "²³¼", "'rE 'S", "éte",
    "qwertyuiasdfghjk", "vserzagennzspoph", "a vserzagennzspoph b qwertyuiasdfghjk", " " * 3000, "a" + " " * 37 + "the" + " " * 18 + ".", "x\x00\x00 y",
    "tab\tnew\nline  two   three ", " lead", "日本語 text", "🙂 ok", "▁ literal", "x" * 5000, "-" * 3000, "word " * 4000,
]


def texts(seed=0, n=150):
    rng = random.Random(seed)
    parts = ["the ", "of ", "thi", "on", "ing ", "é", "ß", ". ", "\n", "A", "12", "'s ", ", ", "!", "schön ", "año "]
    return [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 400))) for _ in range(n))]


def frame(spark, rows, names="doc_id long, text string, shard int, file string, n long"):
    return spark.createDataFrame([(i, t, 1, "f", 2) for i, t in rows], names).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts()))
    rows += [(1000 + i, rows[40 + i % 3][1]) for i in range(20)]
    return rows


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def ids(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(wordbpe.default_path())
    return {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs}


# ---- encoder


def test_encoder_equals_the_library(docs, ids):
    e = wordbpe.Encoder(wordbpe.default_path(), remembered=300)
    assert e.fast
    for begin in range(0, len(docs), 37):
        part = docs[begin : begin + 37]
        found, at = wordbpe.with_end(*e.encode([t for _, t in part]), 1)
        for k, (i, _) in enumerate(part):
            assert found[at[k] : at[k + 1]].tolist() == ids[i], i


def test_known_words_are_looked_up(docs, ids, monkeypatch):
    """Sorting all pre-tokens of every batch took most of the encoder's time."""
    some = [(i, t) for i, t in docs if max(map(len, (t or "").encode().split()), default=0) <= 16]
    e = wordbpe.Encoder(wordbpe.default_path())
    first = e.encode([t for _, t in some])
    monkeypatch.setattr(wordbpe, "distinct_spans", None)
    again = e.encode([t for _, t in some])
    assert all((a == b).all() for a, b in zip(first, again, strict=True))
    found, at = wordbpe.with_end(*again, 1)
    assert len(some) > 100 and all(found[at[k] : at[k + 1]].tolist() == ids[i] for k, (i, _) in enumerate(some))


@pytest.mark.parametrize("clash", [False, True])
def test_word_table(clash, monkeypatch):
    if clash:  # all want the last place, so that the rest go on from the first
        monkeypatch.setattr(wordbpe.Words, "_places", lambda self, low, high: np.full(len(low), len(self.low) - 1))
    rng = random.Random(5)
    words = list({bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 17))) for _ in range(300 if clash else 40_000)})
    words += [b"c" * n for n in range(1, 17)]
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths) - lengths
    low, high = wordbpe.Words.keys(np.frombuffer(b"".join(words), np.uint8), starts, lengths)
    table, n = wordbpe.Words(), len(words)
    table._empty(64)  # grows on the way
    for begin in range(0, n, 100):
        part = slice(begin, begin + 100)
        assert (table.find(low[part], high[part]) == -1).all()
        table.enter(low[part], high[part], np.arange(n, dtype=np.int32)[part])
    assert (table.find(low, high) == np.arange(n)).all()


def test_long_words_are_remembered_and_forgotten():
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(wordbpe.default_path()), random.Random(7)
    e = wordbpe.Encoder(wordbpe.default_path(), remembered=20)
    for _ in range(30):
        part = [" ".join("".join(rng.choice("aeé") for _ in range(rng.choice([1, 2, 8, 15, 16, 17, 18, 40]))) for _ in range(6)) for _ in range(5)] * 2
        found, at = e.encode(part)
        assert [found[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode(t, add_special_tokens=False).ids for t in part]


# ---- archives


def test_archives(spark):
    pages = [(5, "http://a/ b", "same"), (3, "http://c", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""), (4, "v", "é\r\n\r\nWARC/1.1"), (6, "v", "z" * 200_000), (7, "w", "short"), (7, "w", "short")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, offset long").repartition(2)
    index, folder = warc.write_archives(df)
    found = {r["page_id"]: r for r in warc.read_records(index, folder, with_payload=True).collect()}
    first = {"same": 3, "": 1}
    for i, _, html in pages:
        data, r = (html or "").encode(), found[i]
        least = first.get(html or "")
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if least in (None, i) else ("revisit", least))
        assert r["payload"] == (None if r["refers_to"] else data)
    some = warc.read_records(index.where("page_id IN (4, 6)"), folder).collect()
    assert sorted(r["page_id"] for r in some) == [4, 6]
    index, folder = warc.write_archives(df, least_bytes=5)
    assert {r["record_type"] for r in warc.read_records(index, folder).collect()} == {"response"}
    index, folder = warc.write_archives(df.limit(0))
    assert warc.read_records(index, folder).count() == 0


def test_damage_is_found(spark, tmp_path):
    import pyarrow as pa  # noqa: F401

    fields, http, payload = warc.parse(warc.record(1, "u", b"abc", "D", None))
    assert (fields["WARC-Type"], http["Content-Length"], payload) == ("response", "3", b"abc")
    with pytest.raises(ValueError):
        warc.parse(b"not a record")


# ---- token store


def test_values_are_those_of_to_pylist():
    import pyarrow as pa

    for column in (
        pa.array([3, -1, 7, 2**62]), pa.array([1, None]), pa.array(["a", "", "é", "a"]), pa.array(["x", "y", "x"], pa.large_string()), pa.array([b"ab", b"", b"c\0"]),
        pa.array([b"ab", None, b"c"]), pa.array([[1, 2], [], [3]], pa.list_(pa.int32())), pa.array([[b"u", b"vw"], [b""], []]), pa.array([[1, None], [2]]), pa.array([[1], None, [2]]), pa.array([0.5, 2.0]),
    ):
        for part in (column, column[1:], column[:1], column[:0]):
            assert values(part) == part.to_pylist()


def test_store_without_end_ids(spark, ids, docs):
    rows = [(5, ""), (1, None), (9, "the the"), (9, ""), (2, "word " * 3000), (30, None)]
    store = token_store.write_store(frame(spark, rows), end_id=None)
    found = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_store(store).collect())
    assert sorted(f[:1] + f[2:] for f in found) == sorted((i, len(own), crc(own)) for i, t in rows for own in [wordbpe.encoder(wordbpe.default_path()).encode([t])[0]])
    assert {f[0]: f[1] for f in found if f[0] != 9} == {1: 0, 2: 0, 5: 3000, 30: 3002} and {f[1] for f in found if f[0] == 9} <= {3000, 3002}


def test_store(spark, docs, ids):
    store = token_store.write_store(frame(spark, docs))
    found = {r["doc_id"]: r for r in token_store.read_store(store).collect()}
    start = 0
    for i in sorted(ids):
        r = found[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids[i]), crc(ids[i]))
        start += len(ids[i])
    chunks = store["chunks"]
    assert chunks.count() == chunks.select("digest").distinct().count() == store["recipes"].select(F.explode("digests")).distinct().count()


@pytest.mark.parametrize("share", [1000, 20, 1])
def test_shared_chunks(spark, share, monkeypatch):
    """Hot chunks, some and none, meet their documents alike."""
    monkeypatch.setattr(skew, "HOT_SHARE", share)
    rows = spark.createDataFrame([(i, i % 3 if i % 3 else i) for i in range(60)] + [(99, None)], "id long, k long")
    groups = rows.where("k IS NOT NULL AND k <> 6").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    found = skew.join_once(rows, groups, "k", "n", 61, ["id"])
    top = {k: max(i for i in range(60) if (i % 3 if i % 3 else i) == k) for k in range(60) if k in (1, 2) or k % 3 == 0}
    wanted = [(i, k, None if k == 6 else 20 if k in (1, 2) else 1, None if k == 6 else top[k]) for i in range(60) for k in [i % 3 if i % 3 else i]]
    assert sorted((r["id"], r["k"], r["n"], r["top"]) for r in found.collect() if r["k"] is not None) == sorted(wanted, key=lambda w: w[0])
    assert found.count() == 61


def test_store_rolls_packs(spark, docs, ids, monkeypatch):
    monkeypatch.setattr(token_store, "PACK_BYTES", 500)
    monkeypatch.setattr(token_store, "FRAME", 256)
    monkeypatch.setattr(token_store, "MOST_SHARDS", 2)
    store = token_store.write_store(frame(spark, docs))
    assert store["chunks"].select("file").distinct().count() > 2 * store["shards"]
    assert {r["doc_id"]: r["ids_crc32"] for r in token_store.read_store(store).collect()} == {i: crc(own) for i, own in ids.items()}


def test_store_empty(spark):
    assert token_store.read_store(token_store.write_store(frame(spark, []))).count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    passage = rng.integers(0, 40_000, 6000).astype(np.int32)
    a, b = (np.concatenate([rng.integers(0, 40_000, n).astype(np.int32), passage]) for n in (37, 901))
    ends, first = token_store.cuts(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    pieces = [{x.tobytes() for x in np.split(ids, own[:-1])} for ids, own in ((a, ends[: first[1]]), (b, ends[first[1] :] - len(a)))]
    assert len(pieces[0] & pieces[1]) >= 0.7 * len(pieces[0])
    sizes = np.diff(np.concatenate([[0], ends[: first[1]]]))
    assert sizes.max() <= token_store.MOST and sizes[:-1].min() >= token_store.LEAST
    assert token_store.merkle([]) != token_store.merkle([b"a"]) != token_store.merkle([b"a", b"b"])


# ---- packing


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_documents(spark, docs, ids):
    rows = packing.pack_documents(frame(spark, docs), capacity=512).collect()
    check_packing(rows, 512)
    found = {(r["doc_id"], r["piece"]): r for r in rows}
    for i, own in ids.items():
        for piece in range(-(-len(own) // 512)):
            r = found.pop((i, piece))
            part = own[piece * 512 : piece * 512 + 512]
            assert (r["start"], r["length"], r["ids_crc32"]) == (piece * 512, len(part), crc(part))
    assert not found
    assert packing.pack_documents(frame(spark, [])).count() == 0


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_best_fit_on_pieces(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, int(rng.integers(1, 600))) if seed % 2 else rng.choice([100, 51, 50, 33, 7, 1], 400)
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.best_fit(dict(zip(values.tolist(), counts.tolist(), strict=True)), 100)
    rows = []
    for s in plan.to_dict("records"):
        for rank in range(s["rank_from"], s["rank_to"]):
            turn = rank - s["rank_from"]
            rows.append({"sequence_id": s["first_sequence"] + turn // s["each"], "offset": s["first_offset"] + turn % s["each"] * s["length"], "length": s["length"]})
    assert len(rows) == len(lengths)
    assert check_packing(rows, 100) == plain_best_fit(lengths.tolist(), 100)


def test_ranks_of_a_hot_length(spark):
    pieces = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 < 2, 40).otherwise(25).cast("long").alias("length"))
    rows = packing.pack(pieces, 100).collect()
    assert len(rows) == 3000 and check_packing(rows, 100) == plain_best_fit([40] * 2000 + [25] * 1000, 100)


# ---- language ID


def language_rows(n=400):
    rng = random.Random(1)
    parts = {"aa": ["tion", "the", "ing", "er"], "bb": ["sch", "ein", "ück", "ung"], "cc": ["ción", "los", "que", "ado"]}
    return [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang) for i in range(n) for lang in [rng.choice(list(parts))]]


def test_language_held_out_accuracy(spark):
    rows = language_rows()
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 --", None), (1003, "日本", "cc"), (1004, "a", None), (1005, "тест", "aa")]
    df = spark.createDataFrame([(*r, 1.0, "q") for r in rows + odd], "doc_id long, text string, lang string, score double, lang_pred string").repartition(3)
    model = langid.train(df.where(~langid.held_out()))
    found = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert len(found) == len(rows) + len(odd)
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(found[i]["lang_pred"] == lang for i, _, lang in test) >= 0.99 * len(test) > 50
    assert [found[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert all(found[i]["lang_pred"] in ("aa", "bb", "cc") for i in (1003, 1004, 1005))
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_grams_stay_within_texts():
    data = ["ab cd", "", "É x", "abcde"]
    bounds = np.cumsum([0, *(len(t.encode()) for t in data)])
    gram, at = langid.grams(np.frombuffer("".join(data).encode(), np.uint8), bounds)
    own = [[g.tobytes() for g in gram[a:b]] for a, b in zip(at[:-1], at[1:], strict=True)]
    assert own[0] == [b"ab c", b"b cd"]
    assert own[1] == [] and own[3] == [b" abc", b"abcd", b"bcde", b"cde "]
    assert own[2] == ["é x".encode()] and langid.grams(np.frombuffer("Éa".encode(), np.uint8), np.array([0, 3]))[0][0].tobytes() == " éa".encode()


def test_language_filter_has_all_languages():
    gram = np.array([123456], np.uint32)
    masks = [np.zeros(1 << 12, np.uint8)]
    for s in langid.slots(gram, 12):
        masks[0][s] |= 5
    found = masks[0][langid.slots(gram, 12)[0]]
    for s in langid.slots(gram, 12)[1:]:
        found &= masks[0][s]
    assert found.tolist() == [5]


def test_language_counts_equal_brute_force(spark):
    """Counts per language from plain sets and the false-positive rate."""
    rows = language_rows(120)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, profile=50, least=2, bits=14)
    plain = lambda t: (g for g in ((" " + t.lower() + " ").encode()[i : i + 4] for i in range(len(t.encode()) - 1)) if g.count(b" ") < 2)
    totals = {}
    for _, t, lang in rows:
        for g in plain(t):
            totals.setdefault(lang, {}).setdefault(g, 0)
            totals[lang][g] += 1
    number = lambda g: int.from_bytes(g, "little")
    profiles = {lang: set(sorted((g for g in own if own[g] >= 2), key=lambda g: (-own[g], number(g)))[:50]) for lang, own in totals.items()}
    slots = lambda g: [int(s[0]) for s in langid.slots(np.array([number(g)], np.uint32), 14)]
    filled = {lang: {s for g in own for s in slots(g)} for lang, own in profiles.items()}
    texts = [t for _, t, _ in rows[:40]]
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found, n = model.counts(np.frombuffer("".join(texts).encode(), np.uint8), bounds)
    assert model.languages == sorted(profiles)
    for k, t in enumerate(texts):
        own = list(plain(t))
        assert n[k] == len(own)
        for b, lang in enumerate(model.languages):
            rate = (len(filled[lang]) / (1 << 14)) ** langid.HASHES
            hits = sum(all(s in filled[lang] for s in slots(g)) for g in own)
            assert abs(found[k, b] - max(0, (hits - len(own) * rate) / (1 - rate))) < 1e-9


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, None, "aa")], "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.languages == [] and {tuple(r) for r in langid.predict(df, model).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    with pytest.raises(ValueError, match="lang_pred"):
        langid.predict(df.withColumn("Lang_Pred", F.lit(1)), model, keep=["Lang_Pred"])


def test_language_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.predict(df, langid.train(df)).count() == 0


# ---- pieces


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece as library

    path = wordbpe.default_path("piece_bpe_32k.model")
    processor = library.SentencePieceProcessor(model_file=path)
    rows = sentencepiece.encode(frame(spark, docs), with_ids=True).collect()
    assert len(rows) == len(docs)
    wanted = dict(docs)
    for r in rows:
        text = wanted[r["doc_id"]] or ""
        assert r["ids"] == processor.encode(text), text[:50]
        assert r["n_ids"] == len(r["ids"]) and r["ids_crc32"] == crc(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(text.replace("▁", " ").encode()).hexdigest()
        assert r["round_trip"] == ("▁" not in text)


def test_runs_of_spaces():
    import sentencepiece as library

    path = wordbpe.default_path("piece_bpe_32k.model")
    m, processor = sentencepiece.PieceModel(path), library.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    runs = [" " * n + tail for n in range(70) for tail in ("", "the", "x  y")] + ["".join(rng.choice(["a", "the ", " " * rng.randrange(1, 60), "\n"]) for _ in range(30)) for _ in range(200)] + [" " * 100_000]
    ids, at = m.encode(runs)
    for k, t in enumerate(runs):
        assert ids[at[k] : at[k + 1]].tolist() == processor.encode(t), t[:80]


# ---- media


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 7680, 7681, 61_440, 200_000])
def test_media_round_trip(size):
    text = random.Random(size).randbytes(size)
    data = media.mux(media.padded(text))
    movie = media.demux(data)
    payload, _ = media.describe(data)
    assert payload == media.padded(text) and len(payload) % 192 == 0 and payload
    assert [c[2] for c in movie.cues] == movie.clusters
    times = [p[1] for p in movie.packets]
    assert times == [24 * i for i in range(len(times))]


def test_lacing():
    rng = random.Random(0)
    for lacing in (media.XIPH_LACING, media.EBML_LACING, media.FIXED_LACING, media.NO_LACING):
        for _ in range(50):
            sizes = [rng.randrange(0, 2000)] * 3 if lacing == media.FIXED_LACING else [rng.choice([0, 1, 254, 255, 256, 510, rng.randrange(20_000)]) for _ in range(1 if lacing == media.NO_LACING else rng.randrange(1, 9))]
            frames = [rng.randbytes(n) for n in (sizes[:1] if lacing == media.NO_LACING else sizes)]
            body = media.lace(frames, lacing)
            assert [body[a:b] for a, b in media.unlace(body, 0, len(body), lacing)] == frames


def test_block_groups_and_unknown_sizes():
    track = media.element(media.TRACKS, media.element(media.TRACK_ENTRY, media.unsigned(media.TRACK_NUMBER, 1) + media.element(media.CODEC_ID, b"X")))
    body = media.unsigned(media.TIMESTAMP, 500) + media.element(media.BLOCK_GROUP, media.element(media.BLOCK, media.block([b"ab", b"cde"], -20, media.EBML_LACING)) + media.unsigned(0xFB, 1))
    data = media.element(media.EBML, b"") + media.element_id(media.SEGMENT) + b"\xff" + track + media.element(0xEC, b"void") + media.element(media.CLUSTER, body)
    movie = media.demux(data)
    assert [(data[a:b], ms, key) for _, ms, a, b, _, key in movie.packets] == [(b"ab", 480.0, False), (b"cde", 480.0, False)]
    with pytest.raises(ValueError):
        media.read_id(b"\x00", 0)


def test_live_clusters():
    """Clusters of unknown size, as live files have them, end at the next one."""
    track = media.element(media.TRACKS, media.element(media.TRACK_ENTRY, media.unsigned(media.TRACK_NUMBER, 1)))
    cluster = lambda time, blob: media.element_id(media.CLUSTER) + b"\x01" + b"\xff" * 7 + media.unsigned(media.TIMESTAMP, time) + media.element(media.SIMPLE_BLOCK, media.block([blob], 0, media.NO_LACING))
    data = media.element(media.EBML, b"") + media.element_id(media.SEGMENT) + b"\xff" + track + cluster(0, b"one") + cluster(40, b"two") + media.element(media.TAGS, b"") + cluster(80, b"three")
    movie = media.demux(data + media.element(media.EBML, b"") + media.element(media.SEGMENT, track + cluster(7, b"four")))
    assert [(ms, c) for _, ms, _, _, c, _ in movie.packets] == [(0, 0), (40, 1), (80, 2), (7, 3)] and len(movie.clusters) == 4
    assert [data[a:b] for _, _, a, b, _, _ in movie.packets[:3]] == [b"one", b"two", b"three"]


def test_null_media(spark):
    rows = spark.createDataFrame([(1, 3, bytearray(media.mux(media.padded(b"abc"))), "x"), (2, 0, None, "y")], "doc_id long, n_bytes long, media binary, feature string")
    found = {r["doc_id"]: r for r in media.features(rows).collect()}
    assert found[1]["payload_bytes"] == 192 and found[2]["feature"] is None and media.packets(rows).select("doc_id").distinct().count() == 1


def test_media_features(spark, docs):
    """The features, worked out from the text alone."""
    rows = {r["doc_id"]: r["feature"] for r in media.store_and_describe(frame(spark, docs[::7])).collect()}
    for i, t in docs[::7]:
        full = media.padded((t or "").encode())
        n, samples = len(full) // 192, np.frombuffer(full, np.uint8).astype(float)
        crossings = sum((a < 128) != (b < 128) for a, b in zip(full[:-1], full[1:], strict=True))
        assert rows[i] == f"A_PCM/INT/LIT 8000Hz 8bit packets={n} clusters={-(-n // 320)} cues={-(-n // 320)} last_ms={(n - 1) * 24} duration_ms={n * 24} mean={samples.mean():.4f} deviation={samples.std():.4f} crossings={crossings}"


def test_media_columns(spark, docs):
    rows = {r["doc_id"]: r for r in media.store_and_describe(frame(spark, docs)).collect()}
    for i, t in docs:
        data = (t or "").encode()
        full = media.padded(data)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.mux(full)).hexdigest() and r["media_bytes"] == len(media.mux(full))
    table = media.packets(media.with_media(frame(spark, docs[:30])))
    total = table.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("begin")).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in total} == {i: rows[i]["payload_bytes"] for i, _ in docs[:30]}
    assert table.where("NOT cued").count() == 0
    assert media.store_and_describe(frame(spark, [])).count() == 0


# ---- token counts


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_token_counts(spark, docs, ids, block):
    found = {r["doc_id"]: r["n_tokens"] for r in token_scan.count_tokens(frame(spark, docs), block_bytes=block).collect()}
    assert found == {i: len(own) for i, own in ids.items()}
    assert token_scan.count_tokens(frame(spark, [])).count() == 0
    assert [tuple(r) for r in token_scan.count_tokens(frame(spark, [(None, None)])).collect()] == [(None, 1, 0)]


def test_scan_of_foreign_files(spark):
    folder = shared_dir(spark, "foreign")
    from cairn.llm.common import BlobWriter

    wanted = []
    for data in ([7, 9, 9, 5, 9], [1, 2, 3], [9], [], [4] * 50 + [9] + [3] * 7):
        out = BlobWriter(folder, ".tokens")
        out.append(np.array(data, "<u2").tobytes())
        out.close()
        start = 0
        for k, x in enumerate(data):
            if x == 9 or k == len(data) - 1:
                wanted.append((out.file, start, k + 1 - start))
                start = k + 1
    names = spark.createDataFrame([(f,) for f in {w[0] for w in wanted}], "file string")
    found = token_scan.scan(spark, folder, token_scan.sizes(folder, names), end_id=9, block_bytes=4)
    assert sorted((r["file"], r["start"], r["n_tokens"]) for r in found.collect()) == sorted(wanted)
    for r in found.groupBy("file").agg(F.max("ordinal").alias("m"), F.count("*").alias("n")).collect():
        assert r["m"] == r["n"] - 1
