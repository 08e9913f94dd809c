"""Operators on token ids, each beside the library whose ids they must give."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlens.llm import bpe, counts, packing, queries, tokenfiles
from fleetlens.llm.subwords import WordVocabulary

from .conftest import ODD


@pytest.fixture
def ids_of(words_path):
    library = Tokenizer.from_file(words_path)
    return library, lambda text: library.encode(text or "", add_special_tokens=False).ids


def checksum(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_are_encoded_as_by_the_library(words_path, ids_of):
    rng = random.Random(2)
    letters = ["abcdefghijklmnopqrstuvwxyz", "ETAOINshr'", "àâäçéèêëîïôöùûüÿßœ", "0123456789", "!?.,;:-_*#", "ab  \t\n", "中文é"]
    texts = ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [t for _, t in ODD]
    found = WordVocabulary(words_path).encode(pa.array(texts))
    assert [np.frombuffer(x.as_buffer(), "<u2").tolist() for x in found] == [ids_of[1](t) for t in texts]


def test_bpe_round_trip(spark, documents, odd, words_path, ids_of):
    library, encode = ids_of
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = lambda t: (len(encode(t)), sha(" ".join(map(str, encode(t)))), sha(library.decode(encode(t), skip_special_tokens=False)))
    got = [tuple(r) for r in queries.QUERIES["op5_bpe"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted((i, *want(t)) for i, t in documents)
    rows = bpe.encode_and_decode(odd, words_path).select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(((i, *want(t)) for i, t in ODD), key=str)
    assert bpe.encode_and_decode(odd.limit(0), words_path).collect() == []


def check_pieces(rows, docs, encode, window):
    by_doc, by_sequence = {}, {}
    for row in rows:
        by_doc.setdefault(row.doc_id, []).append(row)
        by_sequence.setdefault(row.sequence_id, []).append(row)
    want = {}
    for i, t in docs:
        want.setdefault(i, []).append([*encode(t), 1])
    assert set(by_doc) == set(want)
    for i, copies in want.items():
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        for ids in copies:
            assert all(r.doc_tokens == len(x) for r in pieces for x in copies)
        assert sum(r.length for r in pieces) == sum(map(len, copies))
        assert all(checksum(copies[0][r.start:r.start + r.length]) == zlib.crc32(bytes(r.ids)) for r in pieces)
    for pieces in by_sequence.values():
        at = 0
        for row in sorted(pieces, key=lambda r: r.offset):
            assert row.offset == at
            at += row.length
        assert at <= window
    return sum(r.length for r in rows) / (window * len(by_sequence))


def test_packing(spark, documents, odd, words_path, ids_of):
    docs = spark.createDataFrame(documents, "doc_id bigint, text string")
    assert check_pieces(packing.pack(docs, words_path, 1).collect(), documents, ids_of[1], 2048) > 0.97
    check_pieces(packing.pack(odd, words_path, 1, window=64).collect(), ODD, ids_of[1], 64)
    assert packing.pack(odd.limit(0), words_path, 1).collect() == []


def test_differencing_balances():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 257, 1200).tolist()
    chosen, windows = packing.fill_windows(sizes, 2048)
    sums = np.bincount(chosen, sizes, windows)
    assert sums.max() <= 2048 and sums.max() - sums.min() < 40 and windows <= -(-sum(sizes) // 2048) + 1
    assert packing.differencing([8, 7, 6, 5, 4], 2).tolist().count(0) in (2, 3)
    assert sorted(np.bincount(packing.differencing([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4])) == [14, 16]
    assert packing.fill_windows([2048] * 3)[1] == 3


def test_token_files(spark, documents, odd, words_path, ids_of):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op8_token_files"](spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for i, t in sorted(documents):
        ids = [*ids_of[1](t), 2]
        assert got[i] == (start, len(ids), checksum(ids))
        start += len(ids)
    rows = tokenfiles.read_token_files(tokenfiles.write_token_files(odd, words_path, 2, length=16), length=16).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in ODD), key=lambda i: -1 if i is None else i)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert sorted(bytes(r.ids) for r in rows) == sorted(np.array([*ids_of[1](t), 2], "<u4").tobytes() for _, t in ODD)
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(odd.limit(0), words_path, 2)).collect() == []


def test_token_files_are_fixed_size_lists_read_without_copies(spark, odd, words_path):
    manifest = tokenfiles.write_token_files(odd, words_path, 2, length=16).collect()
    place, path = pa.fs.FileSystem.from_uri(manifest[0].file)
    reader = tokenfiles.PartReader(place, path, 16)
    batch = reader.file.get_batch(0)
    assert batch.schema.field("ids").type == pa.list_(pa.uint16(), 16)
    assert sum(np.sum(reader.file.get_batch(n).column("mask").flatten().to_numpy(zero_copy_only=False))
               for n in range(reader.file.num_record_batches)) == manifest[0].tokens
    assert np.shares_memory(reader.tokens(3, 5), reader.batch(0))


def test_prefix_counts(spark, documents, odd, pieces_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
    count = lambda t: len(library.encode(t or ""))
    got = queries.QUERIES["op7_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (i, len((t or "").encode()), count(t), count(t) > 4096) for i, t in documents)
    table = counts.prefix_table(odd, pieces_path)
    assert sorted(((r.doc_id, r.n_tokens) for r in table.collect()), key=str) == sorted(((i, count(t)) for i, t in ODD), key=str)
    kept = {r.doc_id: r.kept_chars for r in counts.within_budget(table, 20).collect()}
    for i, t in ODD:
        t = t or ""
        assert kept[i] == max([0] + [p for p in range(1, len(t) + 1) if count(t[:p]) <= 20][-1:])
    assert counts.prefix_table(odd.limit(0), pieces_path).collect() == []


def test_every_prefix(pieces_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
    counter = counts.PrefixCounter(pieces_path)
    rng = random.Random(4)
    letters = ["abcdefghinorst", " ▁", "éß\n\t中漢", "0123456789.,", "the of and", "\x00<s>"]
    texts = ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    totals, changes = counter.count(pa.array(texts))
    for text, total, change in zip(texts, totals, changes):
        sums = np.cumsum(np.frombuffer(change.as_buffer(), np.int8), dtype=int)
        assert total == len(library.encode(text))
        assert [sums[p] for p in range(1, len(text) + 1)] == [len(library.encode(text[:p])) for p in range(1, len(text) + 1)]
