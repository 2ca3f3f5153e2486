"""The pipeline, stage by stage, against brute force; and the registered queries."""

import os
import random
from collections import defaultdict

import pytest

import corpus_pipeline
from cairn.llm import queries
from test_dedup import brute_links, lower, words
from test_records import check_packing


def documents():
    rng = random.Random(11)
    passage = " ".join(words(rng, 70, 10**6))
    rows = []
    for i in range(80):
        own = words(rng, rng.randrange(30, 200), 10**6)
        if i % 5 == 0:
            own.insert(rng.randrange(len(own)), passage)
        rows.append([i, " ".join(own), rng.choice(["en", "de"])])
    rows += [[100 + i, rows[i][1].upper(), "en"] for i in range(10)]
    rows += [[200 + i, rows[i][1] + f" tail{i}", None] for i in range(10, 20)]
    rows += [[300, None, "en"], [301, "", "de"], [302, "123 !!", None], [303, passage, "en"], [304, "a", "en"], [305, passage, "de"]]
    return [(i, t, lang, f"s{i % 3}", len(t or "")) for i, t, lang in rows]


def cut_text(rows, size):
    first = {}
    for i, t in rows:
        data = t.encode()
        for a in range(len(data) - size + 1):
            w = data[a : a + size]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in rows:
        data = t.encode()
        gone = [False] * len(data)
        for a in range(len(data) - size + 1):
            if first[data[a : a + size]] < i:
                gone[a : a + size] = [True] * size
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g).decode()
        if not any(gone) or kept.strip():
            out[i] = kept
    return out


def test_stages(spark, tmp_path):
    rows = documents()
    path = f"file://{tmp_path}/sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, path).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.collect())
    text = {r[0]: r[1] for r in rows}
    has_letter = {i: t for i, t in text.items() if t and any(map(str.isalpha, t))}
    assert {r["doc_id"]: r["text"] for r in seen[0]} == has_letter
    groups = defaultdict(list)
    for i, t in has_letter.items():
        groups[lower(t)].append(i)
    assert {r["doc_id"] for r in seen[1]} == {max(g) for g in groups.values()}
    distinct = [(r["doc_id"], r["text"]) for r in seen[1]]
    stay = {i for i, _, c in brute_links(distinct, 5, 80) if i == c}
    assert {r["doc_id"] for r in seen[2]} == stay and len(stay) < len(distinct)
    want = cut_text([x for x in distinct if x[0] in stay], corpus_pipeline.PASSAGE_BYTES)
    assert {r["doc_id"]: r["text"] for r in seen[3]} == want and any(want[i] != text[i] for i in want)
    assert all(r["n_chars"] == len(r["text"]) for r in seen[3])
    assert {r["doc_id"] for r in seen[4]} == set(want) and check_packing([r.asDict() for r in seen[4]], 4096)
    assert corpus_pipeline.run(spark, path).count() == len(seen[4])


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, _key string, class long, kept string, digest string"


def odd_rows():
    rng = random.Random(3)
    base, other = (" ".join(words(rng, 60, 10**6)) for _ in range(2))
    rows = [(1, base, "en"), (2, base + " near", "en"), (2, other, "de"), (None, base + " zilch", "en"), (None, base + " zilch", "en"), (None, "none of these", None), (7, None, "en"), (None, None, None), (None, "", "de"), (9, " \t", None), (9, " \t", None), (5, "twice here now", "en"), (5, "twice here now", "en")]
    return [(i, t, lang, "s", len(t or ""), 0.5, "x", "k", 3, "kept", "d") for i, t, lang in rows]


def test_odd_rows(spark):
    """Null and repeated ids, repeated rows, and extra columns named like inner ones."""
    rows = odd_rows()
    docs = spark.createDataFrame(rows, EXTRA).repartition(3)
    text = lambda found: sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str)
    stage1, stage2, stage3, stage4, stage5 = (f for _, f in corpus_pipeline.STAGES)
    found = stage1(spark, docs, "")
    assert found.columns == docs.columns and text(found) == sorted(((r[0], r[1]) for r in rows if r[1] and r[1].strip()), key=str)
    found = stage2(spark, docs, "")
    assert found.columns == docs.columns and sorted((t or "").lower() for _, t in text(found)) == sorted({(r[1] or "").lower() for r in rows})
    assert (5, "twice here now") in text(found) and (7, None) in text(found)
    found = stage3(spark, docs, "")
    base, other = rows[0][1], rows[2][1]
    assert found.columns == docs.columns
    assert text(found) == sorted([(1, base), (2, other), (None, "none of these"), (7, None), (None, None), (None, ""), (9, " \t"), (9, " \t"), (5, "twice here now")], key=str)
    found = stage4(spark, docs, "")
    assert found.columns == docs.columns and text(found) == sorted([(r[0], {base + " near": " near", base + " zilch": "zilch"}.get(r[1], r[1])) for r in rows], key=str)
    assert len(stage5(spark, docs, "").collect()) == len(rows)


def test_no_rows(spark):
    docs = spark.createDataFrame([], EXTRA)
    for name, function in corpus_pipeline.STAGES:
        found = function(spark, docs, "")
        assert found.count() == 0 and (name == "best_fit_packing" or found.columns == docs.columns)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "12", None, "s", 2), (None, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [tuple(r) for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [(1, "some words", None, "s", 10)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_registered(spark, name):
    sf = "/root/testdata/sf0.001"
    found = queries.QUERIES[name](spark, sf)
    key = "page_id" if name.startswith("op1_") else "doc_id"
    ids = [r[key] for r in found.select(key).collect()]
    table = spark.read.parquet(f"{sf}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    assert set(ids) == {r[key] for r in table.select(key).collect()}
    if not name.startswith("op6_"):
        assert len(ids) == len(set(ids))
