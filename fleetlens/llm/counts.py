"""Exact token counts of every prefix of a text, by dynamic programming over a byte-pair piece model.

The pieces of a prefix end in one piece, before which stand the pieces of a shorter prefix. Whether a piece may follow
another depends on these two alone: merges inside both run as they would alone until one crosses the border, so a row of
pieces is the model's own exactly if every two neighbours encode to themselves. Hence the count of a prefix is one more than
that of the prefix before its last piece, and the last piece is the one candidate that may follow. No text is encoded as a
whole, and a text's counts are the counts of its words one after the other, since no piece holds a space behind another
character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import slices, texts

SPACE = "▁"
"""What the model writes for a space; a text may hold it too and means the same."""

RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")

CACHED = 250_000
"""Words, and twice as many pairs of pieces, that a task keeps between batches; they only save work."""

PAIR_BITS = 21

BREAK = "\n"


class PrefixCounter:
    """Prefix counts of words under one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError(f"{path}: only models that keep every character of a text are counted by prefix")
        rules.add_dummy_prefix = False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        names = [p.piece for p in model.pieces if p.type == p.NORMAL]
        if any(SPACE in name.lstrip(SPACE) for name in names):
            raise ValueError(f"{path}: a piece crosses the start of a word")
        if any(BREAK in name for name in names):
            raise ValueError(f"{path}: a piece holds a line break")
        own = zip(names, self.library.encode(names))
        self.pieces = {name: ids[0] for name, ids in own if len(ids) == 1}
        self.names = {number: name for name, number in self.pieces.items()}
        self.longest = max(map(len, self.pieces))
        if self.longest > 100:
            raise ValueError(f"{path}: changes of the count must fit a byte")
        self.first_unknown = self.library.vocab_size()
        self.follows: dict[int, bool] = {}
        self.known: dict[str, tuple[int, bytes]] = {}

    def text_of(self, piece: int) -> str:
        return self.names[piece] if piece < self.first_unknown else chr(piece - self.first_unknown)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the model leaves the two pieces as they are when they stand side by side."""
        if left < self.first_unknown and right < self.first_unknown:
            return self.library.encode(self.names[left] + self.names[right]) == [left, right]
        a, b = self.text_of(left), self.text_of(right)
        return self.library.encode(a + b) == self.library.encode(a) + self.library.encode(b)

    def run(self, parts: list[str]) -> None:
        """Fill ``known`` for sorted words; a word goes on where its beginning is that of the word before it.

        Kept are the count of the whole word and the change of the count at each character as signed bytes. A character that
        is no piece is written as its UTF-8 bytes, one token each.
        """
        pieces, follows, longest, unknown = self.pieces, self.follows, self.longest, self.first_unknown
        last, count, before = [0], [0], ""
        for word in parts:
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del last[shared + 1:], count[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                for start in range(end - longest if end > longest else 0, end):
                    piece = pieces.get(word[start:end])
                    cost = 1
                    if piece is None:
                        if start < end - 1:
                            continue
                        piece, cost = unknown + ord(word[start]), len(word[start].encode())
                    if start:
                        key = last[start] << PAIR_BITS | piece
                        fits = follows.get(key)
                        if fits is None:
                            fits = follows[key] = self.may_follow(last[start], piece)
                        if not fits:
                            continue
                    last.append(piece)
                    count.append(count[start] + cost)
                    break
                else:
                    raise AssertionError(f"no piece ends at {end} of {word!r}")
            before = word
            self.known[word] = (count[-1], bytes([(b - a) & 255 for a, b in zip(count, count[1:])]))

    def words(self, words: list[str]) -> list[tuple[int, bytes]]:
        """Count and changes of each word; a word with line breaks, which no piece holds, is looked up line by line."""
        known = self.known
        if len(known) > CACHED:
            known.clear()
        if len(self.follows) > 2 * CACHED:
            self.follows.clear()
        units: set[str] = {BREAK}
        for word in words:
            units.update(word.split(BREAK) if BREAK in word else (word,))
        units.discard("")
        self.run(sorted(u for u in units if u not in known))
        line = known[BREAK]
        out = []
        for word in words:
            if BREAK not in word:
                out.append(known[word])
                continue
            found = []
            for part in word.split(BREAK):
                found += [line, known[part]] if part else [line]
            found = found[1:]
            out.append((sum(x[0] for x in found), b"".join([x[1] for x in found])))
        return out

    def split(self, column: pa.Array) -> pa.ListArray:
        """The words of each text, without the space that begins each; runs of spaces stay with the word behind them."""
        odd = pc.or_(pc.or_(pc.match_substring(column, "  "), pc.match_substring(column, SPACE)),
                     pc.or_(pc.starts_with(column, " "), pc.ends_with(column, " ")))
        odd = pc.or_(odd, pc.equal(column, ""))
        plain = pc.split_pattern(column, " ")
        if not pc.any(odd).as_py():
            return plain
        lists = [[w[1:] for w in RUNS.findall(SPACE + text.replace(" ", SPACE))] if text else []
                 for text in column.filter(odd).to_pylist()]
        both = pa.concat_arrays([plain.filter(pc.invert(odd)), pa.array(lists, plain.type)])
        flags = odd.to_numpy(zero_copy_only=False)
        place = np.where(flags, np.cumsum(flags) - 1 + int((~flags).sum()), np.cumsum(~flags) - 1)
        return both.take(pa.array(place))

    def count(self, column: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The token count of each text, and the changes of the count along it, the first for the space put before it."""
        words = self.split(column)
        coded = words.flatten().dictionary_encode()
        found = self.words([SPACE + w for w in coded.dictionary.to_pylist()])
        table = pa.array([x[1] for x in found], pa.binary())
        per_word = np.array([x[0] for x in found], np.int64)
        offsets = words.offsets.to_numpy()
        offsets = offsets - offsets[0]
        sums = np.concatenate([[0], np.cumsum(per_word[coded.indices.to_numpy()])]) if len(coded) else np.zeros(1, np.int64)
        changes = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), table.take(coded.indices)), b"")
        return sums[offsets[1:]] - sums[offsets[:-1]], changes


@lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    """One loaded model per Python worker."""
    return PrefixCounter(path)


def prefix_table(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``changes``.

    ``changes`` has one signed byte per character and one before them; the sum of the first ``p + 1`` is the exact token
    count of the first ``p`` characters, for ``p`` from 1 on. A null text is empty and has no token; repeated rows are
    counted each; a null ``doc_id`` stays null; other columns are not read; an empty table gives no row. Nothing is shuffled.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(model)
        for part in slices(batches, "text"):
            column = texts(part.column("text"))
            counts, changes = counter.count(column)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pc.binary_length(column).cast(pa.int64()), pa.array(counts, pa.int64()), changes],
                ["doc_id", "n_bytes", "n_tokens", "changes"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(counted, "doc_id bigint, n_bytes bigint, n_tokens bigint, changes binary")


def within_budget(table: DataFrame, limit: int) -> DataFrame:
    """Answers from the stored counts: ``over_limit``, and ``kept_chars``, the most leading characters with up to ``limit`` tokens."""

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("n_tokens").to_numpy()
            kept = np.zeros(len(counts), np.int64)
            for row, changes in enumerate(batch.column("changes")):
                steps = np.frombuffer(changes.as_buffer(), np.int8)
                if counts[row] <= limit:
                    kept[row] = max(0, len(steps) - 1)
                    continue
                fits = np.flatnonzero(np.cumsum(steps, dtype=np.int64)[1:] <= limit)
                kept[row] = fits[-1] + 1 if len(fits) else 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), batch.column("n_tokens"), pa.array(counts > limit), pa.array(kept)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars"])

    return table.mapInArrow(answered, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, kept_chars bigint")
