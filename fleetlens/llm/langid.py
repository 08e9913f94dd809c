"""Language by fusing evidence: text, declared markup language, address suffix and host.

The posterior of a language is its prior at the host, times the likelihood of the text, of the declaration and of the address
given the language. Text likelihoods come from letter trigrams. How far declarations and addresses can be trusted, and how
languages spread over hosts, are grouped sums over all rows; a host's prior is smoothed towards its domain's and that towards
the whole. ``und`` (undetermined) is a hypothesis of its own, under which all trigrams are alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import shared_dir
from .arrowio import slices, texts

SAMPLE = 40_000
"""Most labelled rows that the text model is fitted on; their whole texts are read."""

BINS = 1 << 15

SLICE = 512 * 1024
"""Text that a task looks at in one piece; its trigrams take some thirty times as much."""
NONE = "und"

OVERLAP = 1 / 3
"""Weight of a trigram: every letter is in three of them."""

SMOOTH_HOST = 20.0
SMOOTH_DOMAIN = 100.0
"""Rows that a domain's prior counts for at its hosts, and the whole's at its domains."""

TRUST = 0.5
"""Rows added to each pair of true and declared language."""

LETTERS = np.zeros(256, np.uint32)
LETTERS[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
LETTERS[65:91] = range(97, 123)

MARKUP = re.compile(r"<|&#?\w++;")
SILENT = re.compile(r"<(script|style)\b", re.I)
CLOSING = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style")}
HTML = re.compile(r"<html\b", re.I)
LANG = re.compile(r"\blang\s*+=\s*+[\"']?([A-Za-z]+)", re.I)


def visible(html: str) -> str:
    """The text of a page: comments, scripts, styles, tags and entities each become a space; what is never closed stays.

    One way through the page, from mark to mark; an end that was once looked for in vain is not looked for again.
    """
    out, at, place, missing = [], 0, 0, set()

    def end_of(kind: str, found: int) -> int:
        if found < 0:
            missing.add(kind)
        return found

    while mark := MARKUP.search(html, place):
        low, end = mark.start(), mark.end()
        if html[low] == "<":
            end, silent = -1, SILENT.match(html, low)
            if html.startswith("<!--", low) and "comment" not in missing:
                found = end_of("comment", html.find("-->", low + 4))
                end = found + 3 if found >= 0 else -1
            elif silent and silent[1].lower() not in missing:
                closing = CLOSING[silent[1].lower()].search(html, silent.end())
                end = end_of(silent[1].lower(), closing.end() if closing else -1)
            if end < 0 and "tag" not in missing:
                found = end_of("tag", html.find(">", low + 1))
                end = found + 1 if found >= 0 else -1
            if end < 0:
                place = low + 1
                continue
        out += [html[at:low], " "]
        at = place = end
    return "".join([*out, html[at:]])


def declared_language(html: str) -> str | None:
    """The language that the page's first ``html`` tag with one declares, in lower case.

    A tag without one has none in the tags that begin inside it either, so every part of the page is looked at once.
    """
    place = 0
    while tag := HTML.search(html, place):
        end = html.find(">", tag.end())
        found = LANG.search(html, tag.end(), end if end >= 0 else len(html))
        if found:
            return found[1].lower()
        if end < 0:
            return None
        place = end
    return None


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bins of each text's letter trigrams, one text after the other, and where each text's begin and the last ends."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    first = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset]) if len(column) else 0
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[first:first + bounds[-1]]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64)
    code = LETTERS[data]
    whole = code[:-2] << np.uint32(16) | code[1:-1] << np.uint32(8) | code[2:]
    used = (whole & np.uint32(0x00FF00)) > 0
    ends = bounds[1:-1]
    for back in (1, 2):
        crossing = ends[(ends >= back) & (ends - back < len(used))] - back
        used[crossing] = False
    kept = np.concatenate([[0], np.cumsum(used)])
    return ((whole[used] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64), kept[np.minimum(bounds, len(used))]


def fit(labelled: DataFrame, languages: list[str], sample: int = SAMPLE) -> np.ndarray:
    """Log likelihoods of the bins, one row per language, from ``text`` and ``lang`` of up to about ``sample`` rows chosen by hash."""
    rows = labelled.filter(F.col("lang").isin(languages) & F.col("text").isNotNull()).select("lang", F.col("text").cast("string"))
    every = max(1, -(-rows.count() // sample))
    rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BINS), np.int64)
        number = {name: n for n, name in enumerate(languages)}
        for part in slices(batches, "text", SLICE):
            names = np.array([number[name] for name in part.column("lang").to_pylist()], np.int64)
            bins, ends = trigrams(texts(part.column("text")))
            bins += np.repeat(names * BINS, np.diff(ends))
            counts += np.bincount(bins, minlength=counts.size).reshape(counts.shape)
        language, which = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(language, pa.int32()), pa.array(which, pa.int32()), pa.array(counts[language, which])], ["language", "bin", "n"])

    table = np.full((len(languages), BINS), 0.1)
    # Bounded by languages and bins.
    sums = rows.mapInArrow(counted, "language int, bin int, n bigint").groupBy("language", "bin").agg(F.sum("n").alias("n"))
    for language, which, n in sums.collect():
        table[language, which] += n
    return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def with_likelihoods(df: DataFrame, body: str, table: np.ndarray) -> DataFrame:
    """Replace the column ``body`` by ``likelihoods``: the text's weighted log likelihood under each language and, last, ``und``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, body, SLICE):
            bins, ends = trigrams(texts(part.column(body)))
            sums = np.zeros((part.num_rows, len(table) + 1))
            for number, row in enumerate(table):
                total = np.concatenate([[0], np.cumsum(row[bins], dtype=np.float64)])
                sums[:, number] = total[ends[1:]] - total[ends[:-1]]
            sums[:, -1] = -np.log(BINS) * np.diff(ends)
            kept = [name for name in part.schema.names if name != body]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(list(sums * OVERLAP), pa.list_(pa.float64()))], [*kept, "likelihoods"])

    fields = [f for f in df.schema.fields if f.name != body]
    return df.mapInArrow(scored, StructType([*fields, StructField("likelihoods", ArrayType(DoubleType()))]))


def normalised(logs: Column) -> Column:
    """Probabilities from logarithms."""
    most = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - most))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def summed(df: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.array(*[F.sum(F.col("belief")[i]) for i in range(len(names))]).alias("sums"))


def trusted(df: DataFrame, said: str, names: list[str]) -> dict[str, list[float]]:
    """Log likelihood of each said value, null for none, given each language; bounded by the languages."""
    sums = {row[said]: row["sums"] for row in summed(df, [said], names).collect()}
    values = [None, "other", *names]
    table = np.array([sums.get(value, [0.0] * len(names)) for value in values]) + TRUST
    table[:, -1] = 1.0  # nothing is said about the undetermined
    return dict(zip(map(str, values), np.log(table / table.sum(axis=0)).tolist()))


def identify(rows: DataFrame, table: np.ndarray, languages: list[str], body: str = "body") -> DataFrame:
    """Add ``language`` and ``confidence`` to rows with ``body``, ``declared``, ``suffix``, ``host`` and ``domain``.

    ``body`` is dropped; other columns stay, whatever their names but ``likelihoods``, ``belief`` and ``posterior``. Any of the
    five may be null: no text favours no language, a missing declaration or address is evidence as often as it is missing, rows
    without host or domain share one. Languages outside the list count as ``other``. A row's own belief is taken out of its
    host's prior. Ties go to the language that comes first, ``und`` last. Repeated rows are judged each.
    """
    shared_dir(rows.sparkSession)
    names = [*languages, NONE]

    def known(column: str) -> Column:
        return F.when(F.col(column).isNull(), None).when(F.lower(column).isin(languages), F.lower(column)).otherwise("other")

    judged = with_likelihoods(rows, body, table).withColumn("declared", known("declared")).withColumn("suffix", known("suffix"))
    judged = judged.withColumn("belief", normalised(F.col("likelihoods"))).checkpoint()
    said = {column: trusted(judged, column, names) for column in ("declared", "suffix")}
    hosts = summed(judged, ["domain", "host"], names)
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(len(names))]).alias("domain_sums"))
    whole = domains.agg(*[F.sum(F.col("domain_sums")[i]) for i in range(len(names))]).first()
    total = np.array([x or 0.0 for x in whole]) + 1.0
    prior = F.array(*map(F.lit, (total / total.sum()).tolist()))
    # Domain towards the whole, host towards its domain; the row's own belief leaves its host's sums.
    size = lambda sums: F.aggregate(sums, F.lit(0.0), lambda a, b: a + b)
    domains = domains.withColumn("domain_prior", F.zip_with("domain_sums", prior, lambda n, p: (n + p * SMOOTH_DOMAIN) / (size(F.col("domain_sums")) + SMOOTH_DOMAIN)))
    hosts = hosts.withColumnRenamed("domain", "_domain").join(domains.select(F.col("domain").alias("_of"), "domain_prior"), F.col("_domain").eqNullSafe(F.col("_of")))
    hosts = hosts.select("_domain", F.col("host").alias("_host"), "sums", "domain_prior")
    joined = judged.join(hosts, F.col("host").eqNullSafe(F.col("_host")) & F.col("domain").eqNullSafe(F.col("_domain")))
    others = F.zip_with("sums", "belief", lambda n, own: F.greatest(n - own, F.lit(0.0)))
    at_host = F.zip_with(others, "domain_prior", lambda n, p: F.log(n + p * SMOOTH_HOST))
    logs = F.zip_with("likelihoods", at_host, lambda a, b: a + b)
    for column, values in said.items():
        choices = F.array(*[F.array(*map(F.lit, values[v])) for v in [str(None), "other", *names]])
        place = F.coalesce(F.array_position(F.array(*map(F.lit, ["other", *names])), F.col(column)) + 1, F.lit(1)).cast("int")
        logs = F.zip_with(logs, F.element_at(choices, place), lambda a, b: a + b)
    final = joined.withColumn("posterior", normalised(logs)).withColumn("confidence", F.array_max("posterior"))
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("posterior", F.col("confidence")).cast("int"))
    return final.withColumn("language", best).drop("likelihoods", "belief", "posterior", "sums", "domain_prior", "_host", "_domain")


def page_rows(pages: DataFrame) -> DataFrame:
    """``page_id`` with the text outside the markup, the declared language, the address's language part, host and domain."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", SLICE):
            bodies, declared = [], []
            for html in part.column("html").to_pylist():
                declared.append(declared_language(html or ""))
                bodies.append(visible(html or ""))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(bodies, pa.string()), pa.array(declared, pa.string())],
                                             ["page_id", "url", "body", "declared"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.mapInArrow(read, "page_id bigint, url string, body string, declared string")
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    part = F.lower(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    country = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    empty = lambda c: F.when(c != "", c)
    return rows.select("page_id", "body", "declared", F.coalesce(empty(part), empty(country)).alias("suffix"), empty(host).alias("host"),
                       empty(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"))


def page_languages(pages: DataFrame, labelled: DataFrame, languages: list[str]) -> DataFrame:
    """One row per page: ``page_id``, ``declared``, ``suffix``, ``host``, ``language``, ``confidence`` and ``accepted`` (not ``und``)."""
    found = identify(page_rows(pages), fit(labelled, languages), languages)
    return found.select("page_id", "host", "declared", "suffix", "language", "confidence", (F.col("language") != NONE).alias("accepted"))


def rejected_documents(docs: DataFrame, languages: list[str]) -> DataFrame:
    """``doc_id`` and ``mark`` (hash of the text) of documents whose language is undetermined; ``lang`` is the declaration, ``source`` the host."""
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("body"), F.col("lang").alias("declared"),
                       F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), F.lit(None).cast("string").alias("domain"))
    found = identify(rows, fit(docs, languages), languages)
    return found.filter(F.col("language") == NONE).select("doc_id", "mark").distinct()
