"""Language model, language identification and the pipeline."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import attention, langid, lm, queries

from .conftest import ODD
from .test_duplicates import components_by_hand, repeats_by_hand

SMALLEST = "/root/testdata/sf0.001"


def base_by_hand(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None] for _, t in docs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in docs]
    counts = collections.Counter(w for ws, h in zip(words, held) if not h for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    score = lambda w: math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1)))
    return [(i, h, len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(map(score, ws)), 4)) for (i, _), ws, h in zip(docs, words, held)]


def test_language_model_beats_its_counts_on_held_out_texts(spark, documents, odd, words_path):
    rows = queries.QUERIES["op1_lm_score"](spark, SMALLEST).collect()
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows]
    assert sorted(got) == sorted(base_by_hand(documents))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    rows = lm.score_texts(odd, words_path).collect()
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows]
    assert sorted(got, key=str) == sorted(base_by_hand(ODD), key=str)
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm.score_texts(odd.limit(0), words_path).collect() == []


def test_attention_model_learns_from_every_training_text(spark, documents, words_path):
    """The only training text is longer than the former sample took; tables and windows are counted by hand."""
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    docs = spark.createDataFrame([(held + 1, "zq xv " * 150_000), (held, "zq xv " * 50)], "doc_id bigint, text string")
    row = lm.score_texts(docs, words_path).filter("held_out").first()
    assert row.score > 0.6 * row.base_score  # a sure model has 100 words at log10(0.75) and the end

    lm.shared_dir(spark)
    docs = spark.createDataFrame(documents + ODD, "doc_id bigint, text string").withColumn("held", lm.held_out()).repartition(3)
    blocks = docs.mapInArrow(lm.split_texts, f"{lm.Block.KIND}, held array<boolean>").checkpoint()
    counts = blocks.mapInArrow(lm.training_counts, "block bigint, word string, n bigint").groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0")
    library = lm.word_vocabulary(words_path)
    start, end = lm.special_ids(library)
    texts = [t for i, t in documents + ODD if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    ids = [[start, *np.frombuffer(x.as_py(), library.type).tolist(), end] for x in library.encode(lm.lowered(lm.pa.array(texts, lm.pa.string())))]
    got = lm.id_counts(counts, words_path, len(texts))
    assert (got == np.bincount(np.concatenate(ids), minlength=library.size)).all()
    classes = (np.arange(library.size) % attention.CLASSES).astype(np.int16)
    pairs = np.zeros((attention.CLASSES, library.size))
    for one in ids:
        np.add.at(pairs, (classes[one[:-1]], one[1:]), 1)
    assert (lm.class_pairs(blocks, words_path, classes) == pairs).all()
    place, by = attention.neighbour_places(got), attention.projection(np.random.default_rng(1))
    around = np.zeros((library.size, attention.SIDES), np.float32)
    for one in ids:
        keys = attention.neighbour_keys(np.array(one[:-1]), np.array(one[1:]), place)
        np.add.at(around, (keys // attention.SIDES, keys % attention.SIDES), 1)
    assert np.allclose(lm.id_points(blocks, words_path, got, by), attention.projected(around[got > 0], by), atol=1e-4)
    model = attention.from_counts(got, classes, pairs.astype(np.float32), np.random.default_rng(1))
    tasks = blocks.mapInArrow(lambda batches: lm.train_task(batches, words_path, model, 0.001, 1), "part bigint, seen bigint, met binary, change binary").collect()
    met = sum(np.frombuffer(r.met, np.int64) for r in tasks)
    assert (met >= got - np.bincount([one[-1] for one in ids], minlength=library.size)).all()


def test_windows_score_every_place_once():
    lengths = np.array([0, 1, 8, 9, 31, 32, 33, 56, 57, 500])
    text, first, scored = attention.windows(lengths)
    for t, n in enumerate(lengths):
        places = [p for x, f, s in zip(text, first, scored) if x == t for p in range(max(f, s), min(n, f + attention.WINDOW))]
        assert places == list(range(n))


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.integers(0, 40, 3000), rng.integers(20, 60, 3000)])
    return attention.fitted(ids, 80, steps=5)


def test_scores_are_causal_and_sum_to_one(model):
    rng = np.random.default_rng(6)
    ids = rng.integers(0, 60, (1, attention.WINDOW))
    every = np.exp([model.scores(ids, np.full_like(ids, i))[0] for i in range(80)])
    assert np.allclose(every.sum(axis=0), 1, atol=1e-3)
    changed = ids.copy()
    changed[0, 20:] = 7
    assert np.allclose(model.scores(ids, ids)[0, :20], model.scores(changed, ids)[0, :20], atol=1e-5)


def test_context_places_are_not_scored_again(model, monkeypatch):
    rng = np.random.default_rng(8)
    ids, target = rng.integers(0, 60, (2, 3, attention.WINDOW))
    whole = model.scores(ids, target)
    assert np.allclose(model.scores(ids, target, attention.CONTEXT), whole[:, attention.CONTEXT:], atol=1e-5)
    worked, scores = [], attention.Model.scores

    def counted(self, *args):
        worked.append(scores(self, *args))
        return worked[-1]

    monkeypatch.setattr(attention.Model, "scores", counted)
    lengths, step = np.array([0, 200, 1, 32, 33]), attention.WINDOW - attention.CONTEXT
    flat, starts = rng.integers(0, 60, int((lengths + 1).sum())), np.cumsum(lengths + 1) - lengths - 1
    found = np.split(model.score(flat, starts, lengths), np.cumsum(lengths)[:-1])
    assert sum(w.size for w in worked) == 4 * attention.WINDOW + (7 + 1) * step
    for start, length, got in zip(starts, lengths, found):
        for at in range(length):
            first = 0 if at < attention.WINDOW else (at - attention.CONTEXT) // step * step
            window = np.resize(flat[start + first:start + at + 1], attention.WINDOW)
            want = model.scores(window[None], np.full((1, attention.WINDOW), flat[start + at + 1]))[0, at - first]
            assert abs(got[at] - want) < 1e-4


def test_gradients(model):
    rng = np.random.default_rng(7)
    ids = rng.integers(0, 60, (2, attention.WINDOW))
    target = model.classes[rng.integers(0, 60, ids.shape)].astype(np.int64)
    for name in ("q", "k", "v", "o", "hidden", "out", "places"):
        model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
        loss, gradient = model.gradients(ids, target)
        weight = model.weights[name]
        weight[1, 1] += 1e-5
        assert abs((model.gradients(ids, target)[0] - loss) / 1e-5 - gradient[name][1, 1]) < 1e-3
        weight[1, 1] -= 1e-5


def test_trigrams_and_evidence(spark, documents):
    pages = [(1, None, None), (2, "", "http://x"), (3, '<html lang="fr"><p>the and is with that for of to in the and of</p>', "http://a.example.com/fr/1"),
             (4, "<html lang=xx>zzzzqqq xxjjkk vvwwqq zxzxzx qjqjqj kxkxkx wqwqwq", "ftp://u@h.example.com:80"),
             (None, "<p>und der die das ist nicht ein und der", "nonsense"), (4, None, "http://h.de/")]
    pages = spark.createDataFrame(pages, "page_id bigint, html string, url string").withColumn("language", F.lit(1)).withColumn("host", F.lit("c"))
    labelled = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.page_languages(pages, labelled, queries.LANGUAGES).collect()
    got = {(r.page_id, r.host): r for r in rows}
    assert len(rows) == 6
    assert got[(3, "a.example.com")].language == "en" and got[(3, "a.example.com")].declared == "fr"
    assert not got[(4, "h.example.com")].accepted and got[(4, "h.example.com")].declared == "other"
    assert got[(None, None)].language == "de" and got[(4, "h.de")].suffix == "de"
    assert langid.page_languages(pages.limit(0), labelled.limit(0), queries.LANGUAGES).collect() == []


def test_evidence_by_hand(spark):
    """Posterior of each row from plain Python over the same likelihood table."""
    labelled = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = langid.fit(labelled, queries.LANGUAGES)
    rng = np.random.default_rng(1)
    names = [*queries.LANGUAGES, "und"]
    texts = ["the", "der", "le de", "de la", "und is", "qqq zzz", "", None]
    rows = [(i, texts[rng.integers(len(texts))], [None, "en", "fr", "xx"][rng.integers(4)], [None, "de"][rng.integers(2)],
             ["h1", "h2", None][rng.integers(3)], ["d", None][rng.integers(2)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, body string, declared string, suffix string, host string, domain string")
    got = {r.id: (r.language, r.confidence) for r in langid.identify(df, table, queries.LANGUAGES).collect()}
    import pyarrow as pa

    logs = []
    for row in rows:
        bins, _ = langid.trigrams(pa.array([row[1] or ""]))
        logs.append(np.array([t[bins].astype(float).sum() for t in table] + [-np.log(langid.BINS) * len(bins)]) / 3)
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    belief = [soft(x) for x in logs]
    known = lambda v: v if v is None or v in queries.LANGUAGES else "other"

    def trust(column):
        sums = {v: np.full(5, langid.TRUST) for v in (None, "other", *names)}
        for row, b in zip(rows, belief):
            sums[known(row[column])] = sums[known(row[column])] + b
        for v in sums:
            sums[v][-1] = 1.0
        whole = sum(sums.values())
        return {v: np.log(s / whole) for v, s in sums.items()}

    said, address = trust(2), trust(3)
    whole = sum(belief) + 1
    whole = whole / whole.sum()
    for row, log, own in zip(rows, logs, belief):
        domain = sum(b for r, b in zip(rows, belief) if r[5] == row[5])
        domain = (domain + whole * langid.SMOOTH_DOMAIN) / (domain.sum() + langid.SMOOTH_DOMAIN)
        host = sum(b for r, b in zip(rows, belief) if (r[4], r[5]) == (row[4], row[5])) - own
        final = soft(log + np.log(np.maximum(host, 0) + domain * langid.SMOOTH_HOST) + said[known(row[2])] + address[known(row[3])])
        assert got[row[0]][0] == names[int(final.argmax())] and abs(got[row[0]][1] - final.max()) < 1e-6


def test_pipeline(spark, documents):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "repeats", "packing"]
    first = [tuple(r) for r in pipeline.known_language(spark, docs, SMALLEST).collect()]
    assert sorted(first) == sorted(map(tuple, docs.collect()))  # all of them have a language
    second = pipeline.one_of_each_group(spark, docs, SMALLEST).collect()
    assert sorted(r.doc_id for r in second) == sorted(i for i, _, c in components_by_hand(documents) if i == c)
    kept = spark.createDataFrame(second, docs.schema)
    third = pipeline.without_repeats(spark, kept, SMALLEST).collect()
    by_hand = {r[0]: r for r in repeats_by_hand([(r.doc_id, r.text) for r in second])}
    before = {r.doc_id: r for r in second}
    for row in third:
        if by_hand[row.doc_id][2] == 0:
            assert tuple(row) == tuple(before[row.doc_id])
        else:
            assert abs(len(row.text.encode()) - (by_hand[row.doc_id][1] - by_hand[row.doc_id][2])) <= 3 * 2 * by_hand[row.doc_id][3]
            assert row.n_chars == len(row.text)
    assert {i for i, r in by_hand.items() if r[1] > r[2] + 6 * r[3]} <= {r.doc_id for r in third}
    pieces = pipeline.run(spark, SMALLEST).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in third}


def test_another_text_of_a_removed_id_stays(spark):
    import corpus_pipeline as pipeline

    near = " ".join(f"w{i}" for i in range(80))
    clean = " ".join(f"c{i}" for i in range(80))
    rows = [(1, near, "en", "s", 1), (5, near + " more", "en", "s", 2), (5, clean, "en", "s", 3), (5, clean, "en", "s", 3), (5, None, "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = pipeline.one_of_each_group(spark, docs, SMALLEST).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, near), (5, clean), (5, None)], key=str)


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as pipeline

    rows = [(1, "a b", None, None, None, "x"), (1, "a b", None, None, None, "y"), (2, None, "en", "s", 1, None), (None, "x y z w q", "en", "s", None, "z"),
            (None, "x y z w q", None, "s", None, "z"), (4, "", "fr", "s", 0, "z"), (5, "é" * 100 + "long" * 50 + "ü", "fr", "s", 301, "z"),
            (6, "ö" * 100 + "long" * 50 + "ä", "fr", "s", 301, "z")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, mark string")
    for start in (odd, odd.limit(0)):
        docs, sizes = start, []
        for _, stage in pipeline.STAGES:
            out = stage(spark, docs, SMALLEST)
            found = out.collect()
            sizes.append(len(found))
            docs = spark.createDataFrame(found, out.schema)
        assert sizes[:3] == ([8, 7, 7] if start is odd else [0, 0, 0])


OLD_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", re.S | re.I)
OLD_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)


def test_pages_are_read_as_by_plain_patterns():
    rng = random.Random(3)
    bits = ["<", ">", "<!--", "-->", "<script", "</script", "</SCRIPT >", "<style>", "</style>", "<html", "lang", "=", "'", '"', " ", "fr", "en", "&amp;", "&#9;", "&x", ";", "a", "\n", "<scripts>", "<p>", "-"]
    for _ in range(20_000):
        page = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert langid.visible(page) == OLD_HIDDEN.sub(" ", page), page
        found = OLD_DECLARED.search(page)
        assert langid.declared_language(page) == (found[1].lower() if found else None), page


@pytest.mark.parametrize("piece", ["<script>", "<!--", "<html ", "<html lang", "<style x", "<", "&", "&a", "</script ", "<script></script", "lang   "])
def test_hostile_pages_take_no_longer(piece):
    page = piece * (5_000_000 // len(piece))
    started = time.perf_counter()
    langid.visible(page)
    langid.declared_language(page)
    langid.visible("<script>" + page)
    assert time.perf_counter() - started < 30
