"""Cheapest repair of conversations by rank-convergence parallel Viterbi.

A conversation is in order when the initials of its roles read ``(s?(ua)+)?``. The states of
that pattern are the nodes of a trellis: keeping, reroling or deleting a row leads to the
next row, inserting a turn stays before it. Costs run backwards: the vector in front of a
row holds, per state, the cost of the cheapest edits from there to the end.

Long conversations are cut into chunks. Only the last chunk of a conversation knows its
vector; the others start from a speculative one, all at the same time. In fix-up passes a
chunk takes the vector that the chunk after it has found and runs again, side by side
with its last run, until both differ by a constant only: from there on the old run
stays right, but for that constant. When no vector changes any more, the costs of all
chunks fit together, and each chunk is traced forwards from every state that may enter
it, taking at each step the least letter among the cheapest edits. The letters of
different edits differ, so this gives the least text of all cheapest ones. A last stream
per conversation picks the traces that follow each other and hashes the repaired turns.

Rows that have to go (blank or duplicate) add the same cost in every state, so a chunk made of
them alone never converges, nor does one of roles that no state can keep. After ``PASSES``
passes what is still open is run chunk after chunk, each conversation as one stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from demandloom.llm.common import durable, slices, stored

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
# A chunk ends at this many rows or, at the end of a row, bytes of text.
CHUNK_ROWS = 4096
CHUNK_BYTES = 4 << 20
PASSES = 6

BLANKS = " \t\n\v\f\r"
_PREFIX = 64

# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
_NEXT = (2, 2, 3, 2)  # where a user or assistant turn leads
_TURN = {2: "user", 3: "assistant"}  # ... which of the two it is
_OTHER, _SYSTEM, _USER, _ASSISTANT = range(4)
_KEPT = {_SYSTEM: {0: 1}, _USER: {0: 2, 1: 2, 3: 2}, _ASSISTANT: {2: 3}}
_NEVER = 1 << 40
_FINE, _BLANK, _DUPLICATE, _CUT = range(4)

Vector = tuple[int, int, int, int]


def _with_inserts(base: Iterable[int]) -> Vector:
    base = tuple(base)
    after = [base[_NEXT[q]] for q in range(4)]
    return tuple(min(base[q], INSERT + after[q], 2 * INSERT + after[_NEXT[q]]) for q in range(4))


AT_END: Vector = _with_inserts((0, _NEVER, _NEVER, 0))
SPECULATIVE: Vector = (0, 0, 0, 0)


def row_code(kind: int, fault: int) -> int:
    return kind | fault << 2


@cache
def _back(code: int, after: Vector) -> tuple[Vector, int]:
    """The vector in front of a row, less its least entry, and that entry."""
    kind, fault = code & 3, code >> 2
    extra = TRUNCATED if fault == _CUT else 0
    base = []
    for q in range(4):
        cost = DELETE + after[q]
        if fault in (_FINE, _CUT):
            cost = min(cost, REROLE + extra + after[_NEXT[q]])
            if (to := _KEPT.get(kind, {}).get(q)) is not None:
                cost = min(cost, extra + after[to])
        base.append(cost)
    costs = _with_inserts(base)
    least = min(costs)
    return tuple(c - least for c in costs), least


@cache
def _forth(code: int, state: int, after: Vector) -> tuple[str, int]:
    """The letters of the least cheapest edits up to and with a row, and the state behind it."""
    costs, least = _back(code, after)
    kind, fault = code & 3, code >> 2
    extra = TRUNCATED if fault == _CUT else 0
    letters = ""
    while True:
        cost = costs[state] + least
        if cost == DELETE + after[state]:
            return letters + "D", state
        if cost == INSERT + costs[_NEXT[state]] + least:
            letters, state = letters + "I", _NEXT[state]
            continue
        to = _KEPT.get(kind, {}).get(state)
        if fault in (_FINE, _CUT) and to is not None and cost == extra + after[to]:
            return letters + "K", to
        return letters + "R", _NEXT[state]


def run_back(codes: bytes, start: Vector) -> tuple[Vector, int]:
    """The vector in front of a chunk whose last row is followed by ``start``, and what was taken off it."""
    vector, taken = start, 0
    for code in reversed(codes):
        vector, least = _back(code, vector)
        taken += least
    return vector, taken


def fix_up(codes: bytes, start: Vector, old_start: Vector, old_front: Vector) -> tuple[Vector, int]:
    """The vector in front of a chunk that ran from ``old_start`` before, and what is taken off more than then."""
    new, old, more = start, old_start, 0
    for code in reversed(codes):
        if new == old:
            return old_front, more
        new, a = _back(code, new)
        old, b = _back(code, old)
        more += a - b
    return new, more


def trace(codes: bytes, start: Vector, state: int, last: bool) -> tuple[str, int]:
    """The edits of a chunk entered in ``state``, and the state it is left in; with the end of the conversation if ``last``."""
    vectors = [start]
    for code in reversed(codes):
        vectors.append(_back(code, vectors[-1])[0])
    letters = []
    for i, code in enumerate(codes):
        edits, state = _forth(code, state, vectors[len(codes) - 1 - i])
        letters.append(edits)
    if last:
        while state in (1, 2):
            letters.append("I")
            state = _NEXT[state]
    return "".join(letters), state


class _Summary:
    """Counts of a conversation or a chunk of it; chunks add up in order."""

    FIELDS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, least_turn bigint, most_turn bigint, first_initial string, last_initial string, first_turn bigint, last_turn bigint"
    NAMES = [field.split(" ")[0] for field in FIELDS.split(", ")]

    def __init__(self, values: Iterable | None = None):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least_turn = self.most_turn = self.first_turn = self.last_turn = None
        self.first_initial = self.last_initial = None
        if values is not None:
            self.__dict__.update(zip(self.NAMES, values))

    def values(self) -> tuple:
        return tuple(getattr(self, name) for name in self.NAMES)

    def row(self, initial: str, turn: int | None, fault: int) -> None:
        one = (fault == _BLANK, fault == _DUPLICATE, fault == _CUT, 0, turn is not None, turn, turn, initial, initial, turn, turn)
        self.add(_Summary(map(lambda v: int(v) if isinstance(v, bool) else v, one)))

    def add(self, after: _Summary) -> None:
        if self.first_initial is None:
            self.__dict__.update(after.__dict__)
            return
        self.illegal += after.illegal + (self.last_initial + after.first_initial not in ("su", "ua", "au"))
        # turns are in order, so a turn on both sides of a border is the last and the first one
        self.turns += after.turns - (self.last_turn is not None and self.last_turn == after.first_turn)
        for name in ("blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + getattr(after, name))
        if after.least_turn is not None:
            self.least_turn = after.least_turn if self.least_turn is None else self.least_turn
            self.most_turn = after.most_turn
        self.last_initial, self.last_turn = after.last_initial, after.last_turn

    @property
    def gaps(self) -> int:
        return 0 if self.least_turn is None else self.most_turn - self.least_turn + 1 - self.turns


class _Rebuilt:
    """The digest of the repaired turns, row by row."""

    def __init__(self):
        self.state, self.first, self.digest = 0, True, hashlib.sha256()

    def turn(self, role: str, text: str) -> None:
        self.digest.update(("" if self.first else "\n").encode() + f"{role}:".encode() + text.encode())
        self.first = False

    def follow(self, letters: Iterator[str], role: str | None, text: str | None) -> None:
        """Take the edits up to and with the row, or, for ``role`` None, all that are left."""
        for letter in letters:
            if letter == "I":
                self.state = _NEXT[self.state]
                self.turn(_TURN[self.state], "")
                continue
            if letter == "R":
                self.state = _NEXT[self.state]
                self.turn(_TURN[self.state], text)
            elif letter == "K":
                self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
                self.turn(role, text)
            return


_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_RESULT_NAMES = [field.split(" ")[0] for field in _RESULT.split(", ")]


def _result(summary: _Summary, cost: int, audit: str, digest: str) -> tuple:
    return (summary.gaps, summary.blank, summary.duplicate, summary.truncated, summary.illegal, cost, audit, digest)


class _Out:
    """Rows of one schema, given out as batches."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.held = schema, [], 0

    def put(self, size: int = 0, **values) -> None:
        self.rows.append(values)
        self.held += size + 200

    def full(self) -> bool:
        return self.held > 2 << 20

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.held = self.rows, [], 0
        return pa.RecordBatch.from_pylist(rows, schema=self.schema)


def _arrow(schema: str, spark) -> pa.Schema:
    parsed = spark.createDataFrame([], schema).schema
    return pa.schema([(field.name, to_arrow_type(field.dataType)) for field in parsed])


def _with_faults(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, kind, fault)``; an equal row of the same turn is found when rows are in order."""
    ending = F.rtrim("text", F.lit(BLANKS))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    said = ["conv_id", "role", "digest"]
    again = (
        rows.groupBy(*said)
        .agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(*(F.col(name).alias(f"said_{name}") for name in said), "first", F.lit(True).alias("repeats"))
    )
    same = [F.col(name).eqNullSafe(F.col(f"said_{name}")) for name in said]
    later = F.col("repeats").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", _SYSTEM).when(initial == "u", _USER).when(initial == "a", _ASSISTANT).otherwise(_OTHER)
    fault = (
        F.when(ending == "", _BLANK)
        .when(later, _DUPLICATE)
        .when(~F.right(ending, F.lit(1)).isin(".", "!", "?"), _CUT)
        .otherwise(_FINE)
    )
    joined = rows.join(again, same, "left")
    return joined.select("conv_id", "turn", "role", "text", kind.alias("kind"), fault.alias("fault"))


def _packed(rows: DataFrame, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """Rows in order, as results of conversations (``part`` 0) that one task holds whole in one chunk, and
    for all others as turns (1) and chunks (2), placed by ``(task, chunk, pos)``."""
    spark = rows.sparkSession
    place = ["conv_id", "turn", "role"]
    # The beginning of a text is enough to place it; order within a task is by the whole text.
    ordered = rows.repartitionByRange(*place, F.substring("text", 1, _PREFIX)).sortWithinPartitions(*place, "text")
    ordered = ordered.select(*place, "text", "kind", "fault", F.spark_partition_id().alias("task"))
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    schema = f"part int, {conv}, task int, chunk int, pos int, role string, text string, codes binary, {_Summary.FIELDS}, gaps bigint, cost bigint, audit string, repaired_sha256 string"
    arrow = _arrow(schema, spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(arrow)
        own = (object(), None)  # conversation, task
        whole = False  # whether the conversation began behind another one of this task
        chunk, codes, turns, held, summary, before = 0, bytearray(), [], 0, _Summary(), None

        def flush(ended: bool) -> None:
            nonlocal chunk, codes, turns, held, summary
            if not codes:
                return
            conv_id, task = own
            if whole and ended and not chunk:
                front, taken = run_back(codes, AT_END)
                audit, _ = trace(codes, AT_END, 0, True)
                rebuilt, letters = _Rebuilt(), iter(audit)
                for role, text in turns:
                    rebuilt.follow(letters, role, text)
                rebuilt.follow(letters, None, None)
                values = dict(zip(_RESULT_NAMES, _result(summary, front[0] + taken, audit, rebuilt.digest.hexdigest())))
                out.put(len(audit), part=0, conv_id=conv_id, **values)
            else:
                at = {"conv_id": conv_id, "task": task, "chunk": chunk}
                for pos, (role, text) in enumerate(turns):
                    out.put(len(text), part=1, pos=pos, role=role, text=text, **at)
                out.put(len(codes), part=2, codes=bytes(codes), **at, **dict(zip(_Summary.NAMES, summary.values())))
            chunk, codes, turns, held, summary = chunk + 1, bytearray(), [], 0, _Summary()

        for part in slices(batches, 3):
            for conv_id, turn, role, text, kind, fault, task in zip(*(c.to_pylist() for c in part.columns)):
                if own[1] is None or own[0] != conv_id:
                    flush(True)
                    whole, own, chunk, before = own[1] is not None, (conv_id, task), 0, None
                elif len(codes) >= chunk_rows or held >= chunk_bytes:
                    flush(False)
                if out.full():
                    yield out.batch()
                if before == (turn, role, text) and fault != _BLANK:
                    fault = _DUPLICATE
                before = (turn, role, text)
                codes.append(row_code(kind, fault))
                summary.row(role[:1], turn, fault)
                turns.append((role, text))
                held += len(text)
        flush(False)
        if out.rows:
            yield out.batch()

    return ordered.mapInArrow(each, schema)


_KEY = ["conv_id", "task", "chunk"]


def _settled(chunks: DataFrame, passes: int) -> DataFrame:
    """``(conv_id, task, chunk, codes, start, front, taken, is_first, is_last)`` of chunks whose vectors fit together."""
    spark = chunks.sparkSession
    in_order = Window.partitionBy("conv_id").orderBy("task", "chunk")
    links = chunks.select(
        *_KEY, F.lag("chunk").over(in_order).isNull().alias("is_first"),
        F.lead(F.struct("task", "chunk")).over(in_order).alias("next"),
    )
    linked = chunks.select(*_KEY, "codes").join(
        links.select(*(F.col(name).alias(f"link_{name}") for name in _KEY), "is_first", "next"),
        [F.col(name).eqNullSafe(F.col(f"link_{name}")) for name in _KEY],
    )
    conv = f"conv_id {chunks.schema['conv_id'].dataType.simpleString()}"
    state = f"{conv}, task int, chunk int, codes binary, is_first boolean, next struct<task:int,chunk:int>, start array<bigint>, front array<bigint>, taken bigint, changed boolean"
    arrow = _arrow(state, spark)
    names = [field.name for field in arrow]

    def speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.to_pylist()
            for row in found:
                start = AT_END if row["next"] is None else SPECULATIVE
                front, taken = run_back(row["codes"], start)
                row |= {"start": start, "front": front, "taken": taken, "changed": True}
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.to_pylist()
            for row in found:
                given = row.pop("given")
                row["changed"] = False
                if given is not None and given != row["start"]:
                    start, old = tuple(given), row["front"]
                    front, more = fix_up(row["codes"], start, tuple(row["start"]), tuple(old))
                    row |= {"start": start, "front": front, "taken": row["taken"] + more, "changed": list(front) != old}
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front = None
        for batch in batches:  # from the end of each conversation
            found = batch.to_pylist()
            for row in found:
                start = AT_END if row["next"] is None else front
                front, taken = run_back(row["codes"], start)
                row |= {"start": start, "front": front, "taken": taken, "changed": False}
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    now = durable(linked.select(*_KEY, "codes", "is_first", "next").mapInArrow(speculate, state))
    for _ in range(passes):
        if now.where("changed and not is_first").isEmpty():
            break
        behind = now.select(*(F.col(name).alias(f"behind_{name}") for name in _KEY), F.col("front").alias("given"))
        meets = (
            F.col("conv_id").eqNullSafe(F.col("behind_conv_id"))
            & (F.col("next.task") == F.col("behind_task"))
            & (F.col("next.chunk") == F.col("behind_chunk"))
        )
        now = durable(now.join(behind, meets, "left").select(*names, "given").mapInArrow(again, state))
    else:
        if not now.where("changed and not is_first").isEmpty():
            backwards = now.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("task"), F.desc("chunk"))
            now = durable(backwards.select(*names).mapInArrow(in_turn, state))
    return now


def _rebuilt(turns: DataFrame, chunks: DataFrame, settled: DataFrame) -> DataFrame:
    """Results of conversations in several chunks, each of them one stream."""
    spark = turns.sparkSession
    conv = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}"
    traced = f"{conv}, task int, chunk int, costs array<bigint>, audits array<string>, exits array<int>"
    traced_arrow = _arrow(traced, spark)

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                start, codes = tuple(row["start"]), row["codes"]
                each = [trace(codes, start, q, row["next"] is None) for q in ((0,) if row["is_first"] else range(4))]
                found.append(
                    {name: row[name] for name in _KEY}
                    | {"costs": [row["taken"], row["front"][0]], "audits": [a for a, _ in each], "exits": [e for _, e in each]}
                )
            yield pa.RecordBatch.from_pylist(found, schema=traced_arrow)

    edits = settled.select(*_KEY, "codes", "is_first", "next", "start", "front", "taken").mapInArrow(traces, traced)
    known = chunks.select(*(F.col(name).alias(f"known_{name}") for name in _KEY), *_Summary.NAMES)
    heads = edits.join(known, [F.col(name).eqNullSafe(F.col(f"known_{name}")) for name in _KEY]).select(
        *_KEY, F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
        "costs", "audits", "exits", *_Summary.NAMES,
    )
    every = heads.unionByName(turns.select(*_KEY, "pos", "role", "text"), allowMissingColumns=True)
    ordered = every.repartition("conv_id").sortWithinPartitions(*_KEY, "pos")
    schema = f"{conv}, {_RESULT}"
    arrow = _arrow(schema, spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own, begun = _Out(arrow), None, False
        summary, rebuilt, letters, audit, cost, state = _Summary(), _Rebuilt(), iter(""), [], 0, 0

        def close() -> None:
            rebuilt.follow(letters, None, None)
            text = "".join(audit)
            out.put(len(text), conv_id=own, **dict(zip(_RESULT_NAMES, _result(summary, cost, text, rebuilt.digest.hexdigest()))))

        for part in slices(batches, 5):
            for row in part.to_pylist():
                if row["pos"] < 0:
                    if not begun or row["conv_id"] != own:
                        if begun:
                            close()
                            if out.full():
                                yield out.batch()
                        own, begun = row["conv_id"], True
                        summary, rebuilt, audit, cost, state = _Summary(), _Rebuilt(), [], row["costs"][1], 0
                    at = state if len(row["audits"]) > 1 else 0
                    letters = iter(row["audits"][at])
                    audit.append(row["audits"][at])
                    state = row["exits"][at]
                    cost += row["costs"][0]
                    summary.add(_Summary(row[name] for name in _Summary.NAMES))
                else:
                    rebuilt.follow(letters, row["role"], row["text"])
        if begun:
            close()
            yield out.batch()

    columns = [*_KEY, "pos", "role", "text", "costs", "audits", "exits", *_Summary.NAMES]
    return ordered.select(*columns).mapInArrow(each, schema)


def repair(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    chunk_rows: int = CHUNK_ROWS,
    chunk_bytes: int = CHUNK_BYTES,
    passes: int = PASSES,
) -> DataFrame:
    """Per conversation ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows go by turn (null first), then role and text. Null roles and texts are one space. A row's
    first fault counts: blank, duplicate (role and text said before), truncated. Edits are
    Keep (0), Rerole to user or assistant (3), Delete (4, the only one for blank and
    duplicate rows) and Insert of an empty user or assistant turn (3); a truncated row that
    stays costs 3 more. ``audit`` is the least text of edit initials among the cheapest
    repairs. An empty role has no initial and cannot be kept. Rows of a null conversation are one conversation, repeated rows
    are duplicates, an empty table gives an empty table and further columns are not read.

    The hash reads the repaired turns of a conversation one after the other, so a conversation that does
    not fit one chunk is a stream through one task at the end, with one slice of turns and
    its own ``audit`` in memory; faults, costs and traces of its chunks run in many tasks.
    """
    blank = F.lit(" ")
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), blank).alias("role"),
        F.coalesce(F.col(text_col), blank).alias("text"),
    )
    packed = stored(_packed(_with_faults(rows), chunk_rows, chunk_bytes), "turns")
    whole = packed.where("part = 0").select("conv_id", *_RESULT_NAMES)
    turns, chunks = packed.where("part = 1"), packed.where("part = 2")
    return whole.unionByName(_rebuilt(turns, chunks, _settled(chunks, passes)))


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults put in by the checksum of ``conv_id:turn`` modulo 20: 0 drops
    the row, 1 empties its text, 2 takes out ``.!?``, 3 repeats the row, 4 makes it the user's. Nulls are one space,
    in the checksum too; ``conv_id`` and ``turn`` themselves stay null.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(name).cast("string"), blank) for name in ("conv_id", "turn")))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", blank)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), text.alias("text"), fault.alias("fault"))
    return rows.where("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
