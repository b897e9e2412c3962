"""Byte-level BPE by DuckDB recursive queries inside the tasks.

A task cuts its texts into the tokenizer's pieces and collects the different
pieces it has not met. Their bytes are rows (piece, position, token); a recursive
query joins each neighbour pair to the table of merges and contracts, in every
round, the leftmost pair of lowest rank of each piece, until no pair merges. The
tokens of a piece are then put together in order.

Texts are decoded from their own ids: the bytes of every id, in order, laid end to end
and cut where a text's ids end. The same as an ordered aggregation in DuckDB (which the tests hold
it against) took as long as the encoding, so it is a gather here.

A round costs the length of a piece and there are as many rounds as merges, so
the query's rows grow with the square of the piece. Pieces above ``LONG`` bytes
(there is no bound on a run of letters) are contracted in the same order
with a heap.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.llm.common import slices

LONG = 256
_CACHED = 400_000
_BLOCK_BYTES = 1 << 16
_SLICE_BYTES = 2 << 20

# White space as the tokenizer's library has it (the Unicode property).
_WHITE = r"\t-\r \x85\xa0  -     　"
# No piece crosses these borders: a blank and what is not white, or white space.
_CHUNK = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")

# Each row points to the position after it. In a round, every piece joins its neighbour
# pairs to the merges, takes the one of lowest rank and then leftmost (rank and position
# in one number), and loses the row that was merged into its left neighbour.
_CONTRACT = """
with recursive step(piece, pos, token, next, round) as (
    select piece, pos, token, lead(pos) over (partition by piece order by pos), 0 from start
    union all
    select * from (
        with pairs as (
            select l.piece, l.next as gone, r.next as after, (m.merged::bigint << 24) | l.pos as key
            from step l join step r on l.piece = r.piece and l.next = r.pos
            join merges m on m.first = l.token and m.second = r.token
        ), best as (
            select piece, min(key) as key, arg_min(gone, key) as gone, arg_min_null(after, key) as after
            from pairs group by piece
        )
        select s.piece, s.pos,
            case when s.pos = b.key & 16777215 then (b.key >> 24)::int else s.token end,
            case when s.pos = b.key & 16777215 then b.after else s.next end,
            s.round + 1
        from step s join best b using (piece) where s.pos <> b.gone
    )
)
select piece, pos, token, round from step
"""

_DECODE = """
select number, string_agg(text, '' order by place) as text
from sequences join vocabulary using (id) group by number
"""


class ByteBpe:
    """One rank file and the pattern that cuts texts into pieces."""

    def __init__(self, rank_file: str, pattern: str):
        import duckdb

        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        pattern = pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"(?!\S)", f"(?![^{_WHITE}])")
        self.pattern = regex.compile(pattern.replace(r"\s+", f"[{_WHITE}]+"))
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        # packed ids of chunks, and of the pieces that chunks are made of
        self.ids: dict[str, bytes] = {}
        by_id = {rank: token for token, rank in self.ranks.items()}
        self.bytes_of = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.binary())
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        self.db.execute("set temp_directory = ''")
        first, second, merged = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    first.append(a)
                    second.append(b)
                    merged.append(rank)
        merges = pa.table({"first": first, "second": second, "merged": merged}).cast(
            pa.schema([("first", pa.int32()), ("second", pa.int32()), ("merged", pa.int32())])
        )
        # bytes as the characters of the same numbers, so that they add up as text
        texts = [token.decode("latin-1") for token in self.ranks]
        words = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "text": pa.array(texts, pa.string())})
        for name, table in (("merges", merges), ("vocabulary", words)):
            self.db.register("given", table)
            self.db.execute(f"create table {name} as select * from given")
            self.db.unregister("given")

    def _recursive(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece."""
        lengths = np.array([len(piece) for piece in pieces])
        ends = np.cumsum(lengths)
        start = pa.table(
            {
                "piece": np.repeat(np.arange(len(pieces), dtype=np.int32), lengths),
                "pos": (np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)).astype(np.int32),
                "token": self.byte_rank[np.frombuffer(b"".join(pieces), dtype=np.uint8)],
            }
        )
        self.db.register("start", start)
        rows = self.db.sql(_CONTRACT).to_arrow_table()
        self.db.unregister("start")
        piece, pos, token, turn = (rows.column(i).to_numpy() for i in range(4))
        last = np.zeros(len(pieces), dtype=turn.dtype)
        np.maximum.at(last, piece, turn)
        done = np.flatnonzero(turn == last[piece])
        done = done[np.lexsort((pos[done], piece[done]))]
        packed = token[done].astype("<u4").tobytes()
        cuts = (4 * np.searchsorted(piece[done], np.arange(len(pieces) + 1))).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def _by_heap(self, piece: bytes) -> bytes:
        """The same contraction: lowest rank first, of equal ones the leftmost."""
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        right = [*range(1, len(parts)), -1]
        left = [*range(-1, len(parts) - 1)]
        heap: list[tuple[int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and right[at] >= 0:
                joined = parts[at] + parts[right[at]]
                if (rank := self.ranks.get(joined)) is not None:
                    heapq.heappush(heap, (rank, at, len(joined)))

        for i in range(len(parts)):
            offer(i)
        while heap:
            rank, at, size = heapq.heappop(heap)
            after = right[at]
            if parts[at] is None or after < 0 or len(parts[at]) + len(parts[after]) != size:
                continue
            joined = parts[at] + parts[after]
            if self.ranks.get(joined) != rank:
                continue
            parts[at], parts[after], right[at] = joined, None, right[after]
            if right[at] >= 0:
                left[right[at]] = at
            offer(left[at])
            offer(at)
        return _packed(self.ranks[part] for part in parts if part is not None)

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
        """The packed ids of different pieces."""
        out, block, held = {}, [], 0
        todo = []
        for piece in pieces:
            if piece in self.ranks:  # a piece that is a token is that token, whatever its merges
                out[piece] = _packed([self.ranks[piece]])
            elif len(piece) > LONG:
                out[piece] = self._by_heap(piece)
            else:
                block.append(piece)
                held += len(piece)
                if held > _BLOCK_BYTES:
                    todo.append(block)
                    block, held = [], 0
        for block in [*todo, block] if block else todo:
            out.update(zip(block, self._recursive(block)))
        return out

    def decode(self, ids: pa.BinaryArray) -> pa.BinaryArray:
        """The bytes of each packed list of ids; an id without bytes is an error."""
        _, offsets, data = ids.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1] // 4
        flat = np.frombuffer(data, dtype="<u4", count=bounds[-1])[bounds[0] :] if bounds[-1] else np.zeros(0, dtype="<u4")
        whole = self.bytes_of.take(pa.array(flat))
        if whole.null_count:
            raise ValueError("ids without bytes")
        return _cut(whole, bounds - bounds[0])

    def decode_by_query(self, sequences: list[bytes]) -> list[bytes]:
        """The same by an ordered aggregation."""
        out = [b""] * len(sequences)
        if any(sequences):
            lengths = np.array([len(ids) // 4 for ids in sequences])
            ids = np.frombuffer(b"".join(sequences), dtype="<u4").astype(np.int32)
            table = pa.table(
                {
                    "number": np.repeat(np.arange(len(sequences), dtype=np.int32), lengths),
                    "place": np.arange(len(ids), dtype=np.int32),
                    "id": ids,
                }
            )
            self.db.register("sequences", table)
            rows = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("sequences")
            for number, text in zip(rows.column("number").to_pylist(), rows.column("text").to_pylist()):
                out[number] = text.encode("latin-1")
        return out

    def _pieces(self, chunk: str) -> list[str]:
        if chunk.isalpha() or chunk[0] == " " and chunk[1:].isalpha():
            return [chunk]  # letters behind at most one blank are one piece
        return self.pattern.findall(chunk)

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks that are not known yet."""
        cut = {chunk: self._pieces(chunk) for chunk in chunks}
        new = list(set(chain.from_iterable(cut.values())) - self.ids.keys())
        encoded = [piece.encode() for piece in new]
        ids = self.encode_pieces(encoded)
        self.ids.update((piece, ids[own]) for piece, own in zip(new, encoded))
        for chunk, pieces in cut.items():
            if len(pieces) > 1:
                self.ids[chunk] = b"".join(map(self.ids.__getitem__, pieces))

    def encode(self, texts: list[str | None]) -> pa.BinaryArray:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Each different chunk is looked up once; its ids are then laid out in the
        order of the texts, where a text's ids are those between its bounds.
        """
        cut = [_CHUNK.findall(text) if text else [] for text in texts]
        bounds = np.cumsum([0, *map(len, cut)])
        coded = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if len(self.ids) > _CACHED:
            self.ids.clear()
        self.learn(set(chunks) - self.ids.keys())
        return _cut(pa.array(map(self.ids.__getitem__, chunks), pa.binary()).take(coded.indices), bounds)


def _cut(parts: pa.BinaryArray, bounds: np.ndarray) -> pa.BinaryArray:
    """The bytes of ``parts`` between each two bounds as one value, without a copy."""
    _, offsets, data = parts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[bounds] if len(parts) else np.zeros(len(bounds), dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends.tobytes()), data])


def _packed(ids: Iterable[int]) -> bytes:
    return np.fromiter(ids, dtype="<u4").tobytes()


@cache
def tokenizer(rank_file: str, pattern: str) -> ByteBpe:
    return ByteBpe(rank_file, pattern)


def encode_texts(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, ids, decoded)`` for every row: ids packed as little-endian unsigned 32-bit
    integers, and the bytes that decoding the ids gives.

    A null or empty text has no ids and decodes to nothing. Null ids of rows and
    repeated rows stay, an empty table gives an empty table, further columns are
    not read. ``rank_file`` has to be valid on every executor.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(rank_file, pattern)
        for part in slices(batches, 1, _SLICE_BYTES):
            ids = own.encode(part.column(1).to_pylist())
            decoded = own.decode(ids)
            yield pa.RecordBatch.from_arrays([part.column(0), ids, decoded], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def with_tokens(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` and ``round_trip``, whether the ids decode to the text.

    A null text has no ids and round_trip true. Columns of these names are replaced.
    """
    docs = docs.drop("token_ids", "round_trip")
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(rank_file, pattern)
        for part in slices(batches, at, _SLICE_BYTES):
            texts = part.column(at)
            ids = own.encode(texts.to_pylist())
            decoded = own.decode(ids)
            same = pc.equal(pc.fill_null(texts.cast(pa.binary()), b""), decoded)
            flat = np.frombuffer(b"".join(ids.to_pylist()), dtype="<u4").astype(np.int32)
            ends = np.cumsum([0, *(n // 4 for n in pc.binary_length(ids).to_pylist())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), same],
                names=[*part.schema.names, "token_ids", "round_trip"],
            )

    out = type(docs.schema)([*docs.schema.fields]).add("token_ids", T.ArrayType(T.IntegerType())).add("round_trip", "boolean")
    return docs.mapInArrow(each, out)
