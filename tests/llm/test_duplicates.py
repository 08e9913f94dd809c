"""Joins, repeats and components beside brute force."""

import collections
import hashlib
import random
import re
import time
import tracemalloc
import weakref
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import jaccard, queries, suffixes
from fleetlens.llm.arrowio import slices
from fleetlens.llm.components import connected_components

SMALLEST = "/root/testdata/sf0.001"


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def components_by_hand(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    held = collections.defaultdict(list)
    links = []
    for i, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in held[x])
        links += [(i, j) for j, n in common.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n) and None not in (docs[i][0], docs[j][0])]
        for x in s:
            held[x].append(i)
    root = roots(len(docs), links)
    least = {}
    for (i, _), r in zip(docs, root):
        least[r] = i if least.get(r) is None else min(least[r], i)
    return collections.Counter((i, len(s), least[r]) for (i, _), s, r in zip(docs, sets, root))


def near_copies(seed, groups=6, copies=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4)))
    rows, line = [], [word() for _ in range(14)]
    for group in range(groups):
        words = [word() for _ in range(rng.randint(6, 150))]
        for _ in range(copies):
            mine = list(words)
            for _ in range(rng.randint(0, 1 + len(mine) // 25)):
                mine[rng.randrange(len(mine))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join(mine + line * (rng.random() < 0.5))))
    return rows


def test_jaccard_on_documents(spark, documents):
    got = collections.Counter(tuple(r) for r in queries.QUERIES["op10_ngram_jaccard"](spark, SMALLEST).collect())
    assert got == components_by_hand(documents)


@pytest.mark.parametrize("block", [256, 8])
def test_jaccard_on_groups_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(5)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert collections.Counter(tuple(r) for r in got) == components_by_hand(rows)


def test_jaccard_of_odd_rows(spark, odd):
    from .conftest import ODD

    got = collections.Counter(tuple(r) for r in jaccard.near_duplicates(odd).collect())
    assert got == components_by_hand(ODD)
    assert jaccard.near_duplicates(odd.limit(0)).collect() == []


def groups_with_quotations(seed, groups=12, copies=4):
    """Near copies of long texts; the first ones of any two groups have a passage of six words in common."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    quoted = {(a, b): [word() for _ in range(6)] for a in range(groups) for b in range(a)}
    rows = []
    for group in range(groups):
        words = [word() for _ in range(500)]
        for copy in range(copies):
            mine = list(words)
            mine[rng.randrange(len(mine))] = word()
            rows.append((len(rows), " ".join(mine + [w for pair, q in quoted.items() if group in pair and copy == 0 for w in q])))
    return rows


def test_jaccard_sends_no_text_to_blocks_it_quotes(spark, monkeypatch):
    sent, whole = [], jaccard.full_sets
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "full_sets", lambda docs: sent.append(docs.agg(F.sum(F.size("visits"))).first()[0]) or whole(docs))
    rows = groups_with_quotations(2)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert collections.Counter(tuple(r) for r in got) == components_by_hand(rows)
    assert sent == [len(rows)]


@pytest.mark.parametrize("stage", [False, True])
def test_jaccard_frees_its_shuffles(spark, stage):
    import corpus_pipeline

    def shuffles():
        places = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f.name for place in places for f in Path(place.getPath()).rglob("shuffle_*.data")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffles(), spark.conf.get(key, None)
    rows = [(*row, "en", "a", 1) for row in near_copies(7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = corpus_pipeline.one_of_each_group(spark, docs, "") if stage else jaccard.near_duplicates(docs)
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert shuffles() <= before
    kept = len({least for _, _, least in components_by_hand([row[:2] for row in rows])})
    assert found.count() == (kept if stage else len(rows)) and spark.conf.get(key, None) == setting


def test_search_probes_long_lists():
    base = np.arange(100, dtype=np.uint64)
    sets = [np.sort(np.concatenate([base[:90], np.arange(1000 + 20 * i, 1010 + 20 * i, dtype=np.uint64)])) for i in range(6)]
    search = jaccard.Search([*sets, np.arange(50, dtype=np.uint64)])
    assert search.partners(0, np.arange(7) > 0).tolist() == [1, 2, 3, 4, 5]


def repeats_by_hand(docs, length=200):
    texts = [(t or "").encode() for _, t in docs]
    seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = collections.Counter()
    for (i, _), t in zip(docs, texts):
        gone = np.zeros(len(t), bool)
        for at in range(len(t) - length + 1):
            if seen[t[at:at + length]] > 1:
                gone[at:at + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out[(i, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    return out


def repeats(df):
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["high"] - s["low"])
    rows = suffixes.remove_repeats(df).select("doc_id", "n_bytes", size, F.size("spans").cast("bigint"), F.sha2("kept", 256)).collect()
    return collections.Counter(tuple(r) for r in rows)


def shared_passages():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    parts = [text(rng.randint(150, 700)) for _ in range(10)]
    rows = [(1, None), (2, ""), (3, "ab" * 600), (4, "a" * 199), (5, "a" * 200), (6, "a" * 201), (7, parts[0]), (7, parts[0]),
            (None, parts[1] + parts[2]), (None, parts[2] + "x" + parts[1]), (None, None)]
    return rows + [(10 + i, "".join(rng.choice(parts)[rng.randint(0, 60):rng.randint(100, 800)] + text(rng.randint(0, 100)) for _ in range(5)))
                   for i in range(80)]


@pytest.mark.parametrize("hot", [1000, 3])
def test_repeats_in_shared_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = shared_passages()
    assert repeats(spark.createDataFrame(rows, "doc_id bigint, text string")) == repeats_by_hand(rows)


def test_repeats_on_documents_and_odd_rows(spark, documents, odd):
    from .conftest import ODD

    got = collections.Counter(tuple(r) for r in queries.QUERIES["op6_suffix_dedup"](spark, SMALLEST).collect())
    assert got == repeats_by_hand(documents)
    assert repeats(odd) == repeats_by_hand(ODD)
    assert suffixes.remove_repeats(odd.limit(0)).collect() == []


def removed_by_hand(docs):
    raws = [(i, t.encode()) for i, t in docs]
    held = collections.Counter(hash(raw[at:at + 200]) for _, raw in raws for at in range(len(raw) - 199))
    out = {}
    for i, raw in raws:
        gone = np.zeros(len(raw) + 1, np.int64)
        again = [at for at in range(len(raw) - 199) if held[hash(raw[at:at + 200])] > 1]
        np.add.at(gone, again, 1)
        np.add.at(gone, [at + 200 for at in again], -1)
        out[i] = int((np.cumsum(gone[:-1]) > 0).sum())
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeats_in_long_and_periodic_texts(spark, monkeypatch, hot):
    """Texts over several pieces, periods of many lengths, their phases in other texts, and breaks in a period."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "SLICE", 30_000)
    monkeypatch.setattr(suffixes, "PIECE", 500)
    rng = random.Random(hot)
    plain = "".join(rng.choice("abcdefgh") for _ in range(120_000))
    rows = [(1, plain), (2, "own" * 20 + plain[29_900:30_300] + "tail" * 9), (3, "x" * 70_000), (4, "p" + "x" * 199), (5, "q" + "x" * 200 + "r"), (6, "ab" * 20_000), (7, "ba" * 150)]
    for n, period in enumerate((3, 16, 64, 100, 136, 137, 138, 150, 199, 200, 201, 450)):
        unit = "".join(rng.choice("klmnopqr") for _ in range(period))
        rows += [(20 + 3 * n, unit * (1500 // period + 2)), (21 + 3 * n, unit[period // 2:] + unit * 2 + "!" + unit * 3), (22 + 3 * n, (unit * 4)[:199 + period])]
    found = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: sum(s.high - s.low for s in r.spans) for r in found} == removed_by_hand(rows)


def test_a_periodic_text_is_sent_once(spark):
    rows = spark.createDataFrame([(1, "y" * 3_000_000), (2, "yz" * 1_000_000), (3, "0123456789abcdef" * 100_000)], "doc_id bigint, text string")
    docs = rows.withColumn("mark", F.col("doc_id")).withColumn("carried", F.lit(1))
    grams = suffixes.gram_rows(docs).groupBy("mark").agg(F.collect_set("gram").alias("grams")).withColumn("hot", F.array().cast("array<bigint>"))
    sent = suffixes.segment_rows(docs.join(grams, "mark").select("doc_id", "carried", "mark", "text", "grams", "hot")).agg(F.sum(F.length("bytes")).alias("n")).first().n
    assert sent < 20_000
    assert [sum(s.high - s.low for s in r.spans) for r in suffixes.remove_repeats(rows).orderBy("doc_id").collect()] == [3_000_000, 2_000_000, 1_600_000]


def test_joined_runs():
    assert suffixes.joined_runs(np.array([5, 0, 9, 30]), np.array([9, 3, 12, 31])) == [(0, 3), (5, 12), (30, 31)]


def test_levels_merge_geometrically():
    rng = np.random.default_rng(1)
    family = suffixes.SuffixFamily()
    pieces = [rng.integers(0, 3, 260).astype(np.uint8).tobytes() for _ in range(11)]
    for piece in pieces:
        family.add([piece])
    assert [level.batches for level in family.levels] == [8, 2, 1]
    assert not family.repeated.any()
    begin = family.add([b"xx" + pieces[0][20:240]])
    assert np.flatnonzero(family.repeated[begin:family.count]).tolist() == list(range(2, 23))
    assert np.flatnonzero(family.repeated[:61]).tolist() == list(range(20, 41))
    order, _ = suffixes.sort_suffixes(suffixes.eights(np.frombuffer(pieces[3], np.uint8)), np.arange(61))
    assert order.tolist() == sorted(range(61), key=lambda i: pieces[3][i:i + 200])


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(5, 5), (7, 900), (900, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = sorted({x for link in links for x in link if link[0] != link[1]})
    number = {x: i for i, x in enumerate(nodes)}
    root = roots(len(nodes), [(number[a], number[b]) for a, b in links if a != b])
    assert got == {x: min(y for y in nodes if root[number[y]] == root[number[x]]) for x in nodes}


def test_pieces_of_a_long_text_take_bounded_memory():
    """The sums and hashes over a text are held for one piece at a time; they took 200 MB for pieces of 2 MB."""
    data = np.random.default_rng(5).integers(97, 123, 4_000_000).astype(np.uint8)
    tracemalloc.start()
    strings = sum(int(count.sum()) for _, _, count, _, _ in suffixes.segments(data, np.array([0, len(data)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert strings == len(data) - suffixes.LENGTH + 1 and peak < 80 << 20


def test_slices_let_a_batch_go_before_the_next():
    held = []

    def batches():
        for n in range(4):
            assert not [ref for ref in held if ref() is not None]
            batch = pa.RecordBatch.from_pydict({"text": ["some text"] * (n + 1)})
            held.append(weakref.ref(batch))
            yield batch
            del batch

    rows = 0
    for part in slices(batches(), "text", 20):
        rows += part.num_rows
    assert rows == 10


def test_stages_get_small_batches(spark):
    import corpus_pipeline as pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        docs = spark.createDataFrame([(1, "text", "en", "host", 4)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        pipeline.packed(spark, docs, "")
        sizes = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("0123456789"), 1000).alias("text")).mapInArrow(
            lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n bigint").collect()
        assert len(sizes) > 5 and max(r.n for r in sizes) < 5 << 20
        spark.conf.set(key, "1m")
        pipeline.packed(spark, docs, "")
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)
