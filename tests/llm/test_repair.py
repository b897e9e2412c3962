import hashlib
import heapq
import random
import zlib

import pytest

from demandloom.llm import repair
from demandloom.llm.queries import QUERIES
from tests.llm.cases import SF_DIR, clashing

BLANKS = " \t\n\v\f\r"
EMPTY = hashlib.sha256(b"").hexdigest()
STATES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(BLANKS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def plain_repair(rows):
    """Dijkstra over (row, state), ties by the letters: the least pair of cost and audit."""
    faults = plain_faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in kept)
        for role in ("user", "assistant"):
            if role[0] in STATES[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*kept, (role, ""))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, kept))
            _, own, text = rows[i]
            if faults[i] in ("", "truncated"):
                more = 3 if faults[i] else 0
                if own[:1] in STATES[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, own[:1], (*kept, (own, text))))
                for role in ("user", "assistant"):
                    if role[0] in STATES[state]:
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, role[0], (*kept, (role, text))))


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    if not rows:
        return 0, 0, 0, 0, 0, 0, "", EMPTY
    faults = plain_faults(rows)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, text = plain_repair(rows)
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def results(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {row.conv_id: tuple(row[name] for name in names) for row in df.collect()}


def damaged(rows):
    """The faults of the query, in plain Python."""
    out, ids = {}, set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        role = "user" if fault == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * (2 if fault == 3 else 1))
    return {conv: out.get(conv, []) for conv in ids}


def made(seed, n=60, longest=12):
    rng = random.Random(seed)
    texts = ["a.", "b!", "c", "", " \n", "d?  ", "e", "f.", "g."]
    roles = ["user", "assistant", "system", "tool", None, "", "agent"]
    rows = []
    for conv in range(n):
        odd = rng.random()
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(roles) if rng.random() < odd else ("user", "assistant")[turn % 2]
            text = rng.choice([*texts, None]) if rng.random() < 0.5 else f"t{turn}."
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,chunk", [(1, 4096), (2, 1), (3, 3)])
def test_against_every_repair(spark, seed, chunk):
    rows = made(seed)
    table = clashing(spark.createDataFrame(rows, SCHEMA), ["cost", "pos", "first", "codes", "digest"])
    got = results(repair.repair(table, chunk_rows=chunk))
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {conv: plain(own) for conv, own in groups.items()}


def test_chunks_that_never_converge(spark):
    """Roles nobody can keep, and copies only: a stream takes over, with the same result."""
    rows = [(1, i, "tool", f"x{i}.") for i in range(40)] + [(2, i, "user", "same.") for i in range(40)]
    rows += [(3, i, ("user", "assistant")[i % 2], f"y{i}.") for i in range(41)]
    table = spark.createDataFrame(rows, SCHEMA)
    want = results(repair.repair(table))
    assert want == {conv: plain([r[1:] for r in rows if r[0] == conv]) for conv in (1, 2, 3)}
    for passes in (0, 1, 50):
        assert results(repair.repair(table, chunk_rows=4, passes=passes)) == want


def test_vectors_converge():
    rng = random.Random(4)
    codes = bytes(repair.row_code(2 + i % 2 if rng.random() < 0.9 else rng.randrange(4), rng.choice((0, 0, 0, 1, 2, 3))) for i in range(500))
    right, taken = repair.run_back(codes, repair.AT_END)
    guess, first = repair.run_back(codes, repair.SPECULATIVE)
    assert guess == right  # the vectors differ by a constant only
    assert repair.fix_up(codes, repair.AT_END, repair.SPECULATIVE, guess) == (right, taken - first)


def test_query_against_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = results(QUERIES["op12_repair"](spark, SF_DIR))
    assert got == {conv: plain(own) for conv, own in damaged(rows).items()}


def test_awkward_rows(spark, tmp_path):
    rows = made(9, 30) + [(1000 + i, 0, "user", "x.") for i in range(60)] + [(5000, None, None, None), (5000, None, None, None), (None, None, None, None)]
    rows += [(6000, 0, "user", "z" * 300_000 + "."), (6000, 1, "assistant", "é😀?")]
    table = clashing(spark.createDataFrame(rows, SCHEMA), ["label", "fault"])
    for part, name in ((table, "some"), (table.limit(0), "none")):
        part.write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    got = results(QUERIES["op12_repair"](spark, f"{tmp_path}/some"))
    assert got == {conv: plain(own) for conv, own in damaged(rows).items()}
    assert (0, 0, 0, 0, 0, 0, "", EMPTY) in got.values()  # all of its rows dropped
    assert QUERIES["op12_repair"](spark, f"{tmp_path}/none").count() == 0
