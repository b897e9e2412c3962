import random

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from demandloom.llm import components, simhash
from demandloom.llm.queries import QUERIES
from tests.llm.cases import SF_DIR, awkward, clashing, docs, words


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    own = [w for w in lowered.split(" ") if w]
    if not own:
        return 0
    grams = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """``{id: smallest id reachable}`` by comparing all pairs."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", "  ", "A", "A b", "The the THE", "É\x1cé x\x0by  z\n", "a b c d e f" * 9])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_query_against_all_pairs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, SF_DIR).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
    assert len(set(want.values())) < len(want)


def near(rng, center, bits):
    for bit in rng.sample(range(64), bits):
        center ^= 1 << bit
    return center


@pytest.mark.parametrize("crowd", [0, 2, 64])
@pytest.mark.parametrize("seed", [1, 2])
def test_links_connect_what_all_pairs_connect(spark, crowd, seed):
    rng = random.Random(seed)
    prints = set()
    for _ in range(6):  # families of dense near copies, and chains of three-bit steps
        center = rng.getrandbits(64)
        prints |= {near(rng, center, rng.randint(0, 4)) for _ in range(25)}
        for _ in range(6):
            prints.add(center := near(rng, center, 3))
    prints |= {rng.getrandbits(64) for _ in range(20)} | {0, (1 << 64) - 1}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), crowd=crowd)
    for a, b in links.collect():
        assert 0 < ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    want = plain_components({p[0]: p[0] & ((1 << 64) - 1) for p in signed})
    assert {p: got.get(p, p) for (p,) in signed} == want


def test_components_of_a_long_chain_and_of_nothing(spark):
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    odd = spark.createDataFrame([(100, 100), (None, 3), (200, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(chain.unionByName(odd)).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 200: 0}
    assert components.connected_components(chain.limit(0)).count() == 0


def test_awkward_rows(spark):
    table = clashing(awkward(spark), ["fp", "text_hash", "component_id", "group_fp", "__id"])
    got = simhash.simhash_groups(table).collect()
    assert len(got) == table.count()
    by_id = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by_id == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    assert sorted(r.component_id for r in got if r.doc_id is None) == [1, 5]
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 8]
    assert simhash.simhash_groups(table.limit(0)).count() == 0
    assert simhash.keep_one(table.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    base = words(300, 1)
    rows = [(10, " ".join(base)), (11, " ".join(base)), (12, " ".join(base[:-1])), (3, " ".join(words(300, 2)))]
    rows += [(None, "no id at all"), (None, "no id at all")]
    kept = simhash.keep_one(docs(spark, rows)).collect()
    assert {r.doc_id for r in kept} <= {3, 10, 12, None}
    assert {3, 10, None} <= {r.doc_id for r in kept}
    assert sum(r.doc_id is None for r in kept) == 1
