"""The operators bound to the test tables, each over the whole table, and their SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, counts, fim, jaccard, langid, lm, packing, ranked, substrings, suffixes, tokenfiles, vectordup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
LANGUAGES = ["en", "fr", "de", "es"]


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_packing")
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path(WORDS), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_token_files")
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    manifest = tokenfiles.write_token_files(table(spark, folder, "documents"), public_tokenizers.path(WORDS), end_id=2)
    return tokenfiles.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = counts.prefix_table(table(spark, folder, "documents"), public_tokenizers.path(PIECES))
    return counts.within_budget(counted, 4096)


@query("op5_bpe")
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode_and_decode(table(spark, folder, "documents"), public_tokenizers.path(WORDS))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_ngram_jaccard")
def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents"))


@query("op3_nearest")
def op3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@query("op9_near_vectors")
def op9_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectordup.near_duplicate_vectors(table(spark, folder, "embeddings"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, folder, "documents"))
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["high"] - s["low"])
    return found.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_language")
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.page_languages(table(spark, folder, "pages"), table(spark, folder, "documents"), LANGUAGES)


@query("op1_lm_score")
def op1_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_texts(table(spark, folder, "documents"), public_tokenizers.path(WORDS))


@query("op11_substring_dedup", r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), placed AS (
  SELECT doc_id, unnest(range(len(words))) AS place, unnest(words) AS word, words FROM split
), windows AS (
  SELECT doc_id, place, word, CASE WHEN place + 35 <= len(words) THEN md5(array_to_string(words[place + 1:place + 35], ' ')) END AS passage FROM placed
), counted AS (
  SELECT doc_id, place, word, passage IS NOT NULL AND count(*) OVER (PARTITION BY passage) > 1 AS again FROM windows
), covered AS (
  SELECT doc_id, place, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM counted
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS text FROM covered GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
""")
def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.remove_passages(table(spark, folder, "documents"))
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["high"] - s["low"])
    return found.select("doc_id", "n_words", size.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_fill_in_middle", r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || draw[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || draw[9:16])::BIGINT % (len(units) + 1) AS b,
    ('0x' || draw[17:24])::BIGINT % 100 AS c, ('0x' || draw[25:32])::BIGINT % 100 AS d FROM split
), cut AS (
  SELECT doc_id, text, n, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(units[greatest(a, b) + 1:], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 50 THEN 'plain' WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM cut
""")
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, folder, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


@query("op13_ranked_search", r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), sizes AS (
  SELECT doc_id, len(terms)::BIGINT AS n FROM lowered
), corpus AS (
  SELECT count(*) FILTER (n > 0) AS docs, sum(n)::BIGINT AS total FROM sizes
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), held AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM lowered) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, corpus GROUP BY term, docs
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN sizes USING (doc_id), corpus GROUP BY item_id, doc_id
), ordered AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ordered WHERE place <= 50
""")
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)
