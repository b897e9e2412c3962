"""Benchmark passages in documents by pigeonhole edit matching.

Texts are compared as lower-case runs of letters and digits with one space between.
An item of ``m`` characters may differ in ``k = error_rate * m`` edits. It is cut into
``k + 1`` pieces; with at most ``k`` edits one piece is untouched, so it stands in the
document as it is. An automaton of all pieces finds those places in one pass, and
Myers' bit-parallel distance verifies the item around each of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from demandloom.llm.common import slices

ERROR_RATE = 0.05
BLOCK_CHARS = 4_000_000
_TOKEN = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    """Lower-case words with single spaces, between two spaces so that words match whole; empty without words."""
    words = _TOKEN.findall((text or "").lower())
    return f" {' '.join(words)} " if words else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of ``item`` with their offsets, lengths as even as can be."""
    cuts = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def budget(item: str, error_rate: float) -> int:
    return min(int(error_rate * len(item)), len(item) - 1)


def myers(item: str, text: str, errors: int) -> tuple[int, int] | None:
    """``(distance, end)`` of the best place of ``item`` in ``text``, the first of equals; None beyond ``errors``."""
    m = len(item)
    ones, last = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    plus, minus, distance, best = ones, 0, m, None
    for end, c in enumerate(text, 1):
        eq = at.get(c, 0)
        x = eq | minus
        zero = (((x & plus) + plus) ^ plus) | x
        up = minus | ~(zero | plus) & ones
        down = plus & zero
        if up & last:
            distance += 1
        elif down & last:
            distance -= 1
        up = up << 1 & ones  # a match may begin anywhere, so nothing is shifted in
        down = down << 1 & ones
        plus = down | ~(zero | up) & ones
        minus = up & zero
        if distance <= errors and (best is None or distance < best[0]):
            best = (distance, end)
    return best


class Matcher:
    """The automaton of one block of items ``(item_id, normal text)``."""

    def __init__(self, items: list[tuple], error_rate: float):
        self.items = [(item_id, text, budget(text, error_rate)) for item_id, text in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                places.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, tuple[int, int]]:
        """The best ``(distance, end)`` in ``text`` of each item (by number) that is found there."""
        best: dict[int, tuple[int, int]] = {}
        looked: dict[int, tuple[int, int]] = {}
        if not self.items:
            return best
        for end, (length, where) in self.automaton.iter(text):
            for number, offset in where:
                if number in best and best[number][0] == 0:
                    continue
                _, item, errors = self.items[number]
                begin = end + 1 - length - offset
                window = (max(0, begin - errors), min(len(text), begin + len(item) + errors))
                seen = looked.get(number)
                if seen and seen[0] <= window[0] and window[1] <= seen[1]:
                    continue
                looked[number] = window
                if text.startswith(item, begin) and begin >= 0:
                    best[number] = (0, begin + len(item))
                elif found := myers(item, text[window[0] : window[1]], errors):
                    found = (found[0], window[0] + found[1])
                    best[number] = min(best.get(number, found), found)
        return best


def _blocks(items: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, so that no task and no broadcast holds more than one block."""
    block, held = [], 0
    for row in items.select(F.col(item_col), F.col(text_col)).toLocalIterator():
        text = normal(row[1])
        if not text:
            continue
        if block and held + len(text) > block_chars:
            yield block
            block, held = [], 0
        block.append((row[0], text))
        held += len(text)
    if block:
        yield block


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    error_rate: float = ERROR_RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``(doc_id, item_id, distance, match_end)`` per row of ``docs`` and item found in it.

    ``distance`` is the smallest number of edits, ``match_end`` where the first such
    match ends in the document's normal text. The items are the queries: they
    pass through the driver in blocks of ``block_chars`` and each block scans ``docs``
    once, so neither table is ever whole in one place.

    Null, empty and word-less texts on either side match nothing. Null ids stay
    null. Repeated documents and repeated items give repeated rows. Either table
    empty gives an empty table; further columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {items.schema[item_col].dataType.simpleString()}, distance bigint, match_end bigint"
    spark = docs.sparkSession
    kind = to_arrow_type(items.schema[item_col].dataType)
    found = None
    for block in _blocks(items, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast(block)  # at most block_chars characters or one item
        part = rows.mapInArrow(_scan(shared, error_rate, kind), schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def _scan(shared, error_rate: float, kind: pa.DataType):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, error_rate)
        for part in slices(batches, 1):
            at, numbers, distances, ends = [], [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                for number, (distance, end) in matcher.matches(normal(text)).items():
                    at.append(i)
                    numbers.append(matcher.items[number][0])
                    distances.append(distance)
                    ends.append(end)
            if at:
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, type=pa.int64())), pa.array(numbers, type=kind), pa.array(distances, type=pa.int64()), pa.array(ends, type=pa.int64())],
                    names=["doc_id", "item_id", "distance", "match_end"],
                )

    return each


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, **item_cols) -> DataFrame:
    """``docs`` without those that hold an item; decided row by row, without a shuffle. Null texts stay."""
    at = docs.columns.index(text_col)
    for block in _blocks(items, item_cols.get("item_col", "item_id"), item_cols.get("item_text_col", "text"), block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.mapInArrow(_sieve(shared, error_rate, at), docs.schema)
    return docs


def _sieve(shared, error_rate: float, at: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, error_rate)
        for part in slices(batches, at):
            clean = [not matcher.matches(normal(text)) for text in part.column(at).to_pylist()]
            yield part.filter(pa.array(clean, type=pa.bool_()))

    return each
