"""Substring removal, fill-in-middle and ranked search beside brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import fim, queries, ranked, substrings

from .conftest import ODD

SMALLEST = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id bigint, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def passages_by_hand(docs, length=35):
    words = [re.findall(WORD, t or "") for _, t in docs]
    held = collections.Counter(tuple(w[k:k + length]) for w in words for k in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(docs, words):
        gone = set()
        for k in range(len(w) - length + 1):
            if held[tuple(w[k:k + length])] > 1:
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), digest(" ".join(x for at, x in enumerate(w) if at not in gone))))
    return collections.Counter(out)


def removed(found):
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["high"] - s["low"])
    return collections.Counter(tuple(r) for r in found.select("doc_id", "n_words", size, F.sha2("kept", 256)).collect())


def test_substrings_on_documents(spark, documents):
    got = collections.Counter(tuple(r) for r in queries.QUERIES["op11_substring_dedup"](spark, SMALLEST).collect())
    assert got == passages_by_hand(documents)


def shared_passages(seed):
    """Few words, so that matches of all lengths, shared seeds with differing surroundings, and periods occur."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(8)]
    pool = [[rng.choice(words) for _ in range(rng.randint(8, 90))] for _ in range(12)]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.4:
                piece = rng.choice(pool)
                low = rng.randrange(len(piece))
                parts += piece[low:low + rng.randint(1, 80)]
            elif kind < 0.7:
                parts += [rng.choice(words) for _ in range(rng.randint(1, 40))]
            else:
                parts += [rng.choice(words)] * rng.randint(1, 50)
        rows.append((i, rng.choice([" ", "  ", "\n", "\t\x0b"]).join(parts)))
    return rows + [rows[3], rows[3], (None, rows[5][1]), (900, rows[5][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_of_shared_passages(spark, seed):
    rows = shared_passages(seed)
    got = substrings.remove_passages(spark.createDataFrame(rows, SCHEMA))
    assert removed(got) == passages_by_hand(rows)
    for r in got.collect():
        assert all(a.high < b.low for a, b in zip(r.spans, r.spans[1:])) and all(s.high - s.low >= 35 for s in r.spans)


def test_substrings_of_odd_rows(spark, odd):
    found = substrings.remove_passages(odd.withColumn("seed", F.lit(1)).withColumn("runs", F.lit("x")), ["ids"])
    assert removed(found) == passages_by_hand(ODD)
    assert {tuple(r.carried.ids) for r in found.collect()} == {(1,)}
    assert substrings.remove_passages(odd.filter("false")).collect() == []


def test_substrings_of_long_texts(spark):
    """Periods and a passage that starts inside a long text's middle."""
    rng = random.Random(7)
    long = [f"x{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["own"] * 20 + long[100_000:100_060])), (3, "tick tock " * 40_000), (4, "solo " * 35)]
    assert removed(substrings.remove_passages(spark.createDataFrame(rows, SCHEMA))) == passages_by_hand(rows)


def test_a_hot_passage_in_a_third_of_the_rows(spark):
    rng = random.Random(9)
    hot = [f"h{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{rng.randrange(10**6)}" for _ in range(30)] + (hot if i % 3 == 0 else [])
                         + [f"b{rng.randrange(10**6)}" for _ in range(30)])) for i in range(900)]
    got = removed(substrings.remove_passages(spark.createDataFrame(rows, SCHEMA)))
    assert got == passages_by_hand(rows) and sum(r[2] for r in got) == 300 * 60


def test_leftmost_least_place():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 7, 24):
        values = rng.integers(0, 6, 200)
        want = [at + int(values[at:at + width].argmin()) for at in range(len(values) - width + 1)]
        assert substrings.sliding_least_place(values, width).tolist() == want


UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def middle_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(UNIT, text)
    name = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(name[at:at + 8], 16) for at in (0, 8, 16, 24))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def middles(df):
    found = fim.fill_in_middle(df)
    rows = found.withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    return collections.Counter(tuple(r)[:6] for r in rows), collections.Counter((r.doc_id, r.back) for r in rows)


def test_middle_on_documents(spark, documents):
    got = collections.Counter(tuple(r) for r in queries.QUERIES["op12_fill_in_middle"](spark, SMALLEST).collect())
    assert got == collections.Counter((*middle_by_hand(i, t)[:5], digest(middle_by_hand(i, t)[5]), digest(t or "")) for i, t in documents)


def test_middle_of_odd_and_long_rows(spark, odd):
    rng = random.Random(3)
    rows = [(100 + i, "".join(rng.choice("ab é\n\t中 \x0b\x85<PSM>") for _ in range(rng.choice((1, 7, 400, 30_000))))) for i in range(120)]
    rows += [(300 + i, t) for i, t in enumerate(["x" * 3_000_000, " " * 300_000, "é " * 500_000 + "\n", "a<S>b", "<M>", "<P", "S>"] * 4)]
    for df, source in ((odd, ODD), (spark.createDataFrame(rows, SCHEMA), rows)):
        made, back = middles(df)
        assert made == collections.Counter(middle_by_hand(i, t) for i, t in source)
        assert back == collections.Counter((i, t or "") for i, t in source)
    assert fim.fill_in_middle(odd.filter("false")).collect() == []


def test_cuts_lie_where_units_end():
    """Chunks of every size, cut anywhere in the bytes, and a memo that forgets."""
    rng = random.Random(1)
    memo = fim.Memo(2000)
    for _ in range(1500):
        text = "".join(rng.choice("ab é\n\t中 \x0b\x85") for _ in range(rng.choice((0, 1, 5, 80, 900))))
        raw = text.encode()
        ends = sorted({rng.randrange(1, len(raw) + 1) for _ in range(rng.randint(0, 30))} | {len(raw)}) if raw else []
        found, units = fim.Chunked(raw, ends, memo), re.findall(UNIT, text)
        assert found.units == len(units)
        for n in {0, len(units), rng.randint(0, len(units))}:
            piece = "".join(units[:n])
            assert found.cut(n) == (len(piece.encode()), len(piece))
    assert memo.held <= 2000 + 4 * 900


def test_shared_passages_share_chunks():
    rng = random.Random(5)
    shared = bytes(rng.randrange(97, 123) for _ in range(200_000))
    def chunks(raw):
        data = np.frombuffer(raw, np.uint8)
        ends = fim.chunk_ends(np.flatnonzero(fim.rolling(data) & fim.MASK == 0) + 1, 0, len(raw))
        return {raw[a:b] for a, b in zip([0, *ends], ends)}
    a, b = chunks(shared), chunks(b"something else before" * 7 + shared)
    assert len(a & b) >= len(a) - 3 and max(map(len, a)) <= fim.MOST


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranking_by_hand(docs, items, k):
    terms = [re.findall(TERM, (t or "").translate(LOWER)) for _, t in docs]
    full, total = sum(bool(t) for t in terms), sum(map(len, terms))
    counts = [collections.Counter(t) for t in terms]
    held = collections.Counter(x for c in counts for x in c)
    out = set()
    for item, text in items:
        scores = []
        for (doc, _), own, c in zip(docs, terms, counts):
            m = 50 + 50 * len(own) * full // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * full + 2) / (2 * held[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 20 * m))
                        for x in set(re.findall(TERM, (text or "").translate(LOWER))) if c[x])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out |= {(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_search_on_documents(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALLEST}/benchmark.parquet").collect()]
    got = {tuple(r) for r in queries.QUERIES["op13_ranked_search"](spark, SMALLEST).collect()}
    assert got == ranking_by_hand(documents, items, 50)


def many_documents(seed, count=3000):
    """Frequent and rare terms, ties in plenty, and documents of very different length."""
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(rng.randrange(10**9), " ".join(rng.choices(words, weights, k=rng.choice((1, 3, 10, 60, 400))))) for _ in range(count)]
    return rows + rows[:40], [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(30)]


@pytest.mark.parametrize("block,stride,share", [(8 << 20, 512, 16), (20_000, 7, 4), (100_000, 32, 10**9)])
def test_search_skips_nothing_that_counts(spark, monkeypatch, block, stride, share):
    monkeypatch.setattr(ranked, "BLOCK_BYTES", block)
    monkeypatch.setattr(ranked, "STRIDE", stride)
    monkeypatch.setattr(ranked, "SHORT_SHARE", share)
    docs, items = many_documents(block)
    got = {tuple(r) for r in ranked.search(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"), 20).collect()}
    assert got == ranking_by_hand(docs, items, 20)


def test_walk_equals_sums():
    """The walk alone, with floors that make lists fall behind."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 4000))
        lists = []
        for _ in range(int(rng.integers(1, 9))):
            docs = np.flatnonzero(rng.random(n) < rng.choice([0.01, 0.2, 0.8]))
            if len(docs):
                lists.append((docs, rng.integers(0, int(rng.choice([3, 1000])), len(docs))))
        if not lists:
            continue
        sums = np.zeros(n, np.int64)
        for docs, values in lists:
            sums[docs] += values
        best, ids = ranked.Best(10), rng.permutation(n)
        ranked.walk(lists, best, ids, np.zeros(n, bool))
        want = sorted((-s, i) for s, i in zip(sums.tolist(), ids.tolist()) if s > 0)[:10]
        assert list(zip((-best.scores).tolist(), best.ids.tolist())) == want


def test_search_in_several_passes_and_of_odd_rows(spark, monkeypatch, odd):
    monkeypatch.setattr(ranked, "QUERY_BYTES", 20)
    items = [(1, "the END q"), (2, None), (3, "..."), (4, "absent"), (5, "中文 σας ²½"), (5, "the"), (1, "the END q"), (None, "b none")]
    df = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1)).withColumn("score", F.lit("s"))
    got = collections.Counter(tuple(r) for r in ranked.search(odd.withColumn("rank", F.lit(0)), df, 5).collect())
    want = collections.Counter()
    for one in {x for x in items}:
        want.update(ranking_by_hand(ODD, [one], 5))
    assert {k for k in got if k[2] != 9} == {k for k in want if k[2] != 9}
    assert ranked.search(odd.filter("false"), df, 5).collect() == [] == ranked.search(odd, df.filter("false"), 5).collect()


def test_lengths_beyond_64_bits():
    sizes = np.array([10**9, 1])
    assert ranked.length_parts(sizes, 10**9, 10**10).tolist() == [50 + 50 * 10**18 // 10**10, 50 + 50 * 10**9 // 10**10]


def test_terms_of_sliced_columns():
    column = pa.array(["zero", None, "Ünder_score A1", "", "b²"]).slice(1)
    offsets, terms = ranked.terms_of(column)
    assert offsets.tolist() == [0, 0, 3, 3, 4] and terms.to_pylist() == ["Ünder", "score", "a1", "b²"]
