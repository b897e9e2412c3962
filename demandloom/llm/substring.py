"""Removal of long word sequences that repeat across documents, by De Bruijn compaction.

Nodes of the graph are ``k - 1`` words, edges the windows of ``k`` words. A document
is a walk of edges. It is cut into paths: consecutive edges that share their
minimizer (the ``anchor`` consecutive words of smallest hash within the window) stay
one row, about ``(k - anchor) / 2`` edges long. Equal windows have equal minimizers, so
two paths can only share edges if they share the minimizer:

* paths whose minimizer stands in one document only are dropped by a join,
* if all paths of a minimizer are the same words, the path does not branch; it
  stays compact, and its smallest document holds every edge of it,
* only the different paths of a branching minimizer are unfolded to edges, once
  per different path, from the text at the path's source coordinates; a join on
  (minimizer, edge) finds the smallest document of each edge.

So an edge is a row only where paths branch. A repeated path carries the bits of
its repeated edges back to every place where it stands, and the words there go.

Paths and edges are told apart by the 64-bit digest of their words within one
64-bit minimizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from demandloom.llm.common import slices, stored, text_hash, utf8_texts

WINDOW = 50
ANCHOR = 12
_CACHED = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_SEED = 7


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        self[word] = value = xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(words: list[bytes], hashes: dict, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each position on, modulo 2**64."""
    n = len(words)
    own = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    powers = np.cumprod(np.full(n, _BASE, dtype=np.uint64))
    back = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(own * powers, dtype=np.uint64)])
    return _mixed((sums[size:] - sums[:-size]) * back[: n - size + 1])


def paths(words: list[bytes], hashes: dict, window: int = WINDOW, anchor: int = ANCHOR) -> list[tuple]:
    """``(minimizer, digest, start, edges)`` of each path of a document, signed 64-bit hashes."""
    if len(words) < window:
        return []
    grams = anchors(words, hashes, anchor)
    width = window - anchor + 1
    place = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
    place += np.arange(len(place))
    starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    edges = np.diff(np.append(starts, len(place)))
    minimizers = grams[place[starts]].view(np.int64).tolist()
    found = []
    for minimizer, start, n in zip(minimizers, starts.tolist(), edges.tolist()):
        digest = xxh3_64_intdigest(b" ".join(words[start : start + n + window - 1]), _SEED)
        found.append((minimizer, digest - (digest >> 63 << 64), start, n))
    return found


def _document_paths(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for part in slices(batches, 2):
            at, rows = [], []
            for i, text in enumerate(utf8_texts(part.column(2))):
                own = paths(text.split(), hashes, window, anchor)
                rows += own
                at += [i] * len(own)
            at = pa.array(at, type=pa.int64())
            minimizer, digest, start, edges = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(1).take(at), pa.array(minimizer, pa.int64()), pa.array(digest, pa.int64()), pa.array(start, pa.int32()), pa.array(edges, pa.int32())],
                names=["doc_id", "text_hash", "minimizer", "digest", "start", "edges"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text_hash", "text")
    return rows.mapInArrow(each, f"doc_id {kind}, text_hash bigint, minimizer bigint, digest bigint, start int, edges int")


def _unfolded(sources: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The edges of each path of ``sources``, from the words at its coordinates."""
    wanted = sources.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("minimizer", "digest", "edges", "start")).alias("wanted")  # at most one per word
    )
    rows = docs.join(wanted, ["doc_id", "text_hash"]).select("doc_id", "wanted", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            at, rows = [], []
            for i, (text, wanted) in enumerate(zip(utf8_texts(part.column(2)), part.column(1).to_pylist())):
                words = text.split()
                for path in wanted:
                    minimizer, digest, edges, start = path["minimizer"], path["digest"], path["edges"], path["start"]
                    for n in range(edges):
                        edge = xxh3_64_intdigest(b" ".join(words[start + n : start + n + window]), _SEED)
                        rows.append((minimizer, digest, edges, n, edge - (edge >> 63 << 64)))
                at += [i] * (len(rows) - len(at))
            columns = zip(*rows) if rows else ((),) * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["first_doc", "minimizer", "digest", "edges", "offset", "edge"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"first_doc {kind}, minimizer bigint, digest bigint, edges int, offset int, edge bigint")


def repeated_marks(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``(doc_id, text_hash, start, mask)`` for ``docs(doc_id, text_hash, text)``.

    Bit ``i`` of ``mask``: the window that starts at word ``start + i`` also starts in a
    document with a smaller id.
    """
    if not 0 < window - anchor < 63:
        raise ValueError("window - anchor has to be from 1 to 62")
    path = ["minimizer", "digest", "edges"]
    places = stored(_document_paths(docs, window, anchor), "paths")
    # Written tables on both sides of a join by a key that may be hot: adaptive execution
    # can then split that key's rows, which it cannot above an aggregation of the same stage.
    shared = stored(
        places.groupBy("minimizer")
        .agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("doc_id", "digest") for f in (F.min, F.max)))
        .where("min_doc_id < max_doc_id")
        .select("minimizer", F.expr("min_digest <> max_digest").alias("branches")),
        "shared",
    )
    repeated = stored(places.join(shared, "minimizer"), "repeated")
    firsts = stored(repeated.groupBy(*path, "branches").agg(F.min("doc_id").alias("first_doc")), "firsts")
    branching = firsts.where("branches").select(*path, F.col("first_doc").alias("doc_id"))
    sources = repeated.where("branches").join(branching, [*path, "doc_id"]).dropDuplicates(path)
    edges = stored(_unfolded(sources, docs, window), "edges")
    smallest = stored(
        edges.groupBy("minimizer", "edge")
        .agg(F.min("first_doc").alias("smallest"), F.max("first_doc").alias("largest"))
        .where("smallest < largest").drop("largest"),
        "smallest",
    )
    masks = (
        edges.join(smallest, ["minimizer", "edge"])
        .where("smallest < first_doc")
        .groupBy(*path)
        .agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("own_mask"))
    )
    known = stored(firsts.drop("branches").join(masks, path, "left"), "known")
    mask = F.when(F.col("doc_id") > F.col("first_doc"), F.expr("shiftleft(1L, edges) - 1")).otherwise(
        F.coalesce("own_mask", F.lit(0).cast("long"))
    )
    return repeated.join(known, path).select("doc_id", "text_hash", "start", mask.alias("mask")).where("mask <> 0")


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR
) -> DataFrame:
    """``(doc_id, n_words, n_removed, spans, kept_text)`` for every row of ``docs``.

    ``spans`` are the removed word ranges ``(start, end)``, end exclusive, in order and not
    touching; ``kept_text`` are the other words, one space between.

    A null text is a text without words and gives an empty ``kept_text``. A row
    with a null id neither loses words nor makes another lose some. Rows of one
    id do not make each other lose words, and repeated rows stay. An empty table
    gives an empty table; further columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    marks = repeated_marks(rows, window, anchor)
    by_document = marks.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            totals, removed, spans, kept = [], [], [], []
            for text, own in zip(utf8_texts(part.column(1)), part.column(2).to_pylist()):
                words = text.split() if text else []
                gone = _ranges(own, window)
                left = [word for a, b in _between(gone, len(words)) for word in words[a:b]]
                totals.append(len(words))
                removed.append(len(words) - len(left))
                spans.append([{"start": a, "end": b} for a, b in gone])
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept_text"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    joined = rows.join(by_document, ["doc_id", "text_hash"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(
        each, f"doc_id {kind}, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_text string"
    )


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _ranges(marks: list[dict] | None, window: int) -> list[tuple[int, int]]:
    """The word ranges under the marked windows, joined where they meet."""
    out: list[list[int]] = []
    for mark in sorted(marks or (), key=lambda m: m["start"]):
        for bit in range(mark["mask"].bit_length()):
            if mark["mask"] >> bit & 1:
                start = mark["start"] + bit
                if out and start <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], start + window)
                else:
                    out.append([start, start + window])
    return [(a, b) for a, b in out]


def _between(gone: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    edges = [0, *(x for span in gone for x in span), n]
    return list(zip(edges[::2], edges[1::2]))
