"""Language of a text by bit-sliced Bloom filters of letter trigrams.

One table of ``positions`` rows holds the filters of all languages side by side,
a bit per language. A trigram's ``HASHES`` rows and-ed together are the mask of
the languages that hold it, found at once for all. A text's trigrams are counted
per language; the count is corrected for the filter's false positives, and the
largest share decides.

A language holds a trigram if it makes up at least ``least_share`` of the
language's trigrams (so at most ``1 / least_share`` of them are held) and its share
is at least ``least_ratio`` of the share in any other language (a stray foreign word
does not fill the filter). The counts behind that cover the whole corpus and are
made and summed on the executors; the driver gets the filter table only, whose
size is fixed by ``positions`` and the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandloom.llm.common import durable, free_names, slices

POSITIONS = 1 << 18
HASHES = 2
LEAST_SHARE = 5e-5
LEAST_RATIO = 0.2
UNKNOWN = "und"
_FLUSH = 1 << 20


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(code).isalpha() for code in range(0x110000)])


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(grams, owner)``: the trigrams of all texts and the number of the text of each.

    Letters in lower case; everything else is a blank, runs of blanks are one,
    and no trigram has a blank in the middle.
    """
    padded = [f" {text.lower()} " if text else "  " for text in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.arange(len(padded), dtype=np.int32), [len(text) for text in padded])
    codes = np.where(_is_letter()[codes], codes, 32).astype(np.uint64)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes, owner = codes[keep], owner[keep]
    if len(codes) < 3:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    middle = codes[1:-1] != 32
    grams = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
    return grams[middle], owner[1:-1][middle]


def positions_of(grams: np.ndarray, positions: int) -> list[np.ndarray]:
    """The rows of each gram, one array per hash (a 64-bit mixer with another start each)."""
    rows = []
    for start in range(1, HASHES + 1):
        x = grams + np.uint64(0x9E3779B97F4A7C15 * start & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        rows.append(((x ^ (x >> np.uint64(31))) % np.uint64(positions)).astype(np.int64))
    return rows


class LanguageFilters:
    """The filters of ``languages``: ``table[position, word]`` holds 64 languages' bits in a word."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table
        filled = [np.mean(self._bit(table, i)) for i in range(len(languages))]
        self.false_rate = np.array(filled, dtype=float) ** HASHES

    @staticmethod
    def _bit(masks: np.ndarray, language: int) -> np.ndarray:
        return (masks[:, language // 64] >> np.uint64(language % 64)) & np.uint64(1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and the score (0 to 1) of each text."""
        grams, owner = trigrams(texts)
        n = np.bincount(owner, minlength=len(texts)).astype(float)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        masks = None
        for rows in positions_of(grams, len(self.table)):
            masks = self.table[rows] if masks is None else masks & self.table[rows]
        share = np.zeros((len(texts), len(self.languages)))
        for i, wrong in enumerate(self.false_rate):
            hits = np.bincount(owner, weights=self._bit(masks, i), minlength=len(texts))
            corrected = (hits - n * wrong) / max(1 - wrong, 1e-9)
            share[:, i] = np.clip(corrected / np.maximum(n, 1), 0, 1)
        best = share.argmax(axis=1)  # of equal ones the first by name
        known = n > 0
        languages = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return languages, np.where(known, share[np.arange(len(texts)), best], 0.0)


def gram_counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """``(lang, gram, n)`` over all texts, summed within a task before the shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            grams, at = np.unique(np.concatenate([g for g, _ in held[lang]]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c for _, c in held[lang]])).astype(np.int64)
            return grams, n

        def out() -> Iterator[pa.RecordBatch]:
            for lang in held:
                grams, n = merged(lang)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), type=pa.string()), pa.array(grams.view(np.int64)), pa.array(n)],
                    names=["lang", "gram", "n"],
                )
            held.clear()

        for part in slices(batches, 1):
            langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            names = sorted(set(langs))
            grams, owner = trigrams(texts)
            of = np.array([names.index(lang) for lang in langs], dtype=np.int32)[owner]
            for i, lang in enumerate(names):
                counted = np.unique(grams[of == i], return_counts=True)
                held.setdefault(lang, []).append(counted)
                size += len(counted[0])
            if size > _FLUSH:
                for lang in held:
                    held[lang] = [merged(lang)]
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > _FLUSH // 2:
                    yield from out()
                    size = 0
        yield from out()

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = rows.where("lang is not null and text is not null").mapInArrow(each, "lang string, gram bigint, n bigint")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_languages(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    positions: int = POSITIONS,
    least_share: float = LEAST_SHARE,
    least_ratio: float = LEAST_RATIO,
) -> LanguageFilters:
    """The filters of all languages that ``docs`` names. Rows without language or text teach nothing."""
    counts = durable(gram_counts(docs, lang_col, text_col))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = [row["lang"] for row in totals.select("lang").sort("lang").collect()]  # as many as there are languages
    words = (len(languages) + 63) // 64
    table = np.zeros((positions, max(1, words)), dtype=np.uint64)
    if not languages:
        return LanguageFilters([], table)
    shares = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    most = F.max("share").over(Window.partitionBy("gram"))  # a row per language
    held = shares.withColumn("most", most).where(
        (F.col("share") >= least_share) & (F.col("share") >= least_ratio * F.col("most"))
    )
    place = {lang: i for i, lang in enumerate(languages)}

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([place[lang] for lang in batch.column(0).to_pylist()], dtype=np.int64)
            grams = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            bit = (np.uint64(1) << (at % 64).astype(np.uint64)).view(np.int64)
            for rows in positions_of(grams, positions):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array(at // 64), pa.array(bit)], names=["position", "word", "mask"]
                )

    bits = held.select("lang", "gram").mapInArrow(insert, "position bigint, word bigint, mask bigint")
    for row in bits.groupBy("position", "word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        table[row["position"], row["word"]] = np.uint64(row["mask"] & 0xFFFFFFFFFFFFFFFF)
    return LanguageFilters(languages, table)


def predict_languages(docs: DataFrame, filters: LanguageFilters, text_col: str = "text") -> DataFrame:
    """``docs`` with two more columns, ``lang_pred`` and ``score``.

    Null texts, empty texts and texts without a letter are ``und`` with score 0,
    and so is every text if nothing was learned. Columns of these two names are
    replaced. An empty table stays empty, repeated rows stay.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # fixed size, see the head of this module
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            languages, scores = shared.value.predict(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(languages, type=pa.string()), pa.array(scores)],
                schema=part.schema.append(pa.field("lang_pred", pa.string())).append(pa.field("score", pa.float64())),
            )

    schema = docs.schema
    out = type(schema)([*schema.fields]).add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(each, out)


def held_out(doc_id: Column) -> Column:
    """One document in four is not learned from; a null id is neither learned from nor held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def reject_unknown(docs: DataFrame, least_score: float, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without those whose language cannot be told: no letters, or a score below ``least_score``.

    Every row with text and language is learned from. If there is none, no text has a
    score, and all with a letter stay.
    """
    filters = learn_languages(docs, lang_col, text_col)
    if not filters.languages:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    own = dict(zip(("lang_pred", "score"), free_names(docs, "lang_pred", "score")))
    tagged = predict_languages(docs.withColumnsRenamed(own), filters, text_col)
    kept = tagged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return kept.drop("lang_pred", "score").withColumnsRenamed({new: old for old, new in own.items()})
