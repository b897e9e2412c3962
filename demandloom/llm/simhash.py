"""Near-duplicate groups by SimHash fingerprints and multi-index hashing.

A fingerprint holds, bit by bit, the majority of the hashes of a text's
shingles. Two fingerprints within ``distance`` bits agree, in one of
``segments`` parts, up to ``distance // segments`` bits. So each fingerprint
looks up, for every part, the small Hamming ball around its own value in a
table of (part, value), and the complete distance of what it finds decides.

A value that more than ``crowd`` fingerprints share (members of one family of
near copies) is not paired out. There each member marks the points of the
64-bit cube around it that keep the shared value, up to half the distance
(rounded up). Fingerprints that mark the same point, one of them from at most
half the distance (rounded down), are linked, and any two linked ones have such
a point between them. A link per mark keeps the work proportional to the family,
and a point has a bounded number of marks because fingerprints are distinct.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from demandloom.llm.common import durable, free_names, slices, text_hash, utf8_texts
from demandloom.llm.components import connected_components

BITS = 64
SHINGLE = 3
DISTANCE = 3
SEGMENTS = 2
CROWD = 64
SEED = 42


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a UTF-8 text; zero without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    join = b" ".join
    if len(words) < shingle:
        grams = [join(words)]
    else:
        grams = map(join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter((xxh64_intdigest(gram, SEED) for gram in grams), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_hash, fp)`` of every row; ``fp`` is the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            values = [fingerprint(text, shingle) for text in utf8_texts(part.column(2))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.array(values, dtype=np.uint64).view(np.int64))],
                names=["doc_id", "text_hash", "fp"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, text_hash bigint, fp bigint")


def _ball(width: int, radius: int, shift: int = 0) -> list[int]:
    """All masks of at most ``radius`` bits among ``width`` bits, as signed longs."""
    masks = [
        sum(1 << (bit + shift) for bit in bits) for r in range(radius + 1) for bits in combinations(range(width), r)
    ]
    return [mask - (1 << BITS) if mask >> (BITS - 1) else mask for mask in masks]


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(value).cast("long") for value in values))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def near_links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``prints(fp)`` that join all within ``distance`` bits.

    Below ``crowd`` members of a value all links come out; in a crowd enough
    of them that every two linked fingerprints are connected.
    """
    width = BITS // segments
    found = []
    for part in range(segments):
        shift = part * width
        size = width if part < segments - 1 else BITS - shift
        value = F.col("fp").bitwiseAND(F.lit(_signed(((1 << size) - 1) << shift)).cast("long"))
        table = prints.select(value.alias("value"), F.col("fp").alias("other"))
        crowds = durable(table.groupBy("value").count().where(F.col("count") > crowd).select("value"))

        # Of two values that differ, only the larger one looks the other up.
        balls = F.transform(_longs(_ball(size, distance // segments, shift)), lambda mask: value.bitwiseXOR(mask))
        probes = prints.select("fp", value.alias("own"), F.explode(F.filter(balls, lambda x: x <= value)).alias("value"))
        quiet = table.join(crowds, "value", "left_anti")
        pairs = probes.join(quiet, "value").where(_distance("fp", "other") <= distance)
        found.append(pairs.where("fp <> other").select(F.col("fp").alias("a"), F.col("other").alias("b")))

        near, far = distance // 2, distance - distance // 2
        gathered = durable(probes.join(crowds, "value", "left_semi").select("fp", "value"))
        rest = [_around(size, BITS - size, shift, far - spent) for spent in range(far + 1)]
        spent = F.bit_count(value.bitwiseXOR(F.col("value")))
        marks = F.coalesce(*(F.when(spent == n, _longs(masks)) for n, masks in enumerate(rest)))
        # the point keeps the shared value and takes the other bits around the member
        base = F.col("fp").bitwiseXOR(value).bitwiseOR(F.col("value"))
        marked = gathered.select("fp", "value", base.alias("base"), F.explode(marks).alias("mask")).select(
            "fp", F.col("base").bitwiseXOR(F.col("mask")).alias("point")
        )
        met = marked.groupBy("point").agg(
            F.min(F.when(_distance("fp", "point") <= near, F.col("fp"))).alias("a"),
            F.collect_set("fp").alias("members"),  # distinct and within `far` bits of the point: bounded
        )
        stars = met.where("a is not null and size(members) > 1").select("a", F.explode("members").alias("b"))
        found.append(stars.where((F.col("a") != F.col("b")) & (_distance("a", "b") <= distance)))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _around(size: int, others: int, shift: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` bits outside the ``size`` bits that start at ``shift``."""
    free = [bit for bit in range(BITS) if not shift <= bit < shift + size]
    assert len(free) == others
    return [_signed(sum(1 << bit for bit in bits)) for r in range(radius + 1) for bits in combinations(free, r)]


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    segments: int = SEGMENTS,
    crowd: int = CROWD,
) -> DataFrame:
    """Near-duplicate group of every row.

    Returns ``doc_id, text_hash, fp, group_fp, component_id``: ``group_fp`` is
    the smallest (signed) fingerprint of the group and names it,
    ``component_id`` is its smallest id. Copies share a fingerprint, so only
    distinct fingerprints are compared.

    A null or empty text, or one of blanks only, has fingerprint 0 like any
    other fingerprint. A null id does not count for ``component_id``, which is
    null if all ids of a group are. Repeated rows stay. An empty table gives an
    empty table; further columns of ``docs`` are not looked at.
    """
    rows = durable(fingerprints(docs, id_col, text_col, shingle))
    prints = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(near_links(prints.select("fp"), distance, segments, crowd))
    placed = prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("group_fp"), "first_id"
    )
    placed = durable(placed)
    firsts = placed.groupBy("group_fp").agg(F.min("first_id").alias("component_id"))
    groups = durable(placed.join(firsts, "group_fp").select("fp", "group_fp", "component_id"))
    return rows.join(groups, "fp").select("doc_id", "text_hash", "fp", "group_fp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (ids in ``doc_id``, texts in ``text``) with one document of each group: the one of the smallest id.

    Without any id in a group, the row of the smallest text hash stays. Rows that
    repeat id and text count as one document.
    """
    groups = simhash_groups(docs, **options)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.col("text_hash").isNull(), "text_hash")
    keepers = groups.groupBy("group_fp").agg(F.min(order).alias("k"))
    own_id, own_hash, key_id, key_hash = free_names(docs, "own_id", "own_hash", "key_id", "key_hash")
    keepers = keepers.select(F.col("k.doc_id").alias(key_id), F.col("k.text_hash").alias(key_hash))
    tagged = docs.withColumns({own_id: F.col("doc_id"), own_hash: text_hash(F.col("text"))})
    kept = tagged.join(
        keepers,
        F.col(own_id).eqNullSafe(F.col(key_id)) & F.col(own_hash).eqNullSafe(F.col(key_hash)),
        "left_semi",
    )
    return kept.dropDuplicates([own_id, own_hash]).drop(own_id, own_hash)
