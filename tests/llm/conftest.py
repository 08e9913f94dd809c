import pytest

pytest.importorskip("fleetlens.llm.queries")


@pytest.fixture
def words_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def pieces_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture
def documents(spark):
    """The smallest documents as rows of (doc_id, text)."""
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


ODD = [(1, None), (2, ""), (3, "   \n"), (4, "a<|endoftext|>b <|startoftext|>"), (5, "ΑΣ Σας İstanbul ét̂ \xa0 x\x1cy 中文 ²½ it's"),
       (6, "x" * 5000), (7, "﻿​ \x85 end"), (8, "The THE the"), (9, "a  b ▁c "), (9, "a  b ▁c "), (None, "none"), (10, "q " * 3000)]


@pytest.fixture
def odd(spark):
    """Null ids and texts, empty, blank and long texts, repeated rows and columns whose names clash with those of the operators."""
    rows = [(i, t, i, "z", 1.0, [1]) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, mark bigint, block string, gram double, ids array<int>")
