import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken

from demandloom.llm import byte_bpe, prefix_tokens
from demandloom.llm.queries import QUERIES
from tests.llm.cases import SF_DIR, awkward, clashing, docs

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", " ", "  a  b\n\n c\t\t", "it's  I'LL don't 123abc   x　 y\x1c z", "日本語テキスト　テスト 😀😀 <s> <0x0A> </s> <unk>",
    "x" * 3000, "ab" * 1000 + " " + "é" * 700, "\x00\x01 \r\n\r\n  q", "ſ's ’s ▁▁ a▁b ▁", "ﬁ ½ Å Å", "the" * 400, "    " * 9 + "i",
    "<|endoftext|><|im_start|>", "a b\x85c​d", "'s't'RE 've",
]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def test_token_counts_as_the_library(spark, library):
    pieces = library[1]
    want = {
        (i, len(t.encode()), n := len(pieces.encode(t)), n > 4096) for i, t in texts(spark).items()
    }
    assert {tuple(r) for r in QUERIES["op6_token_counts"](spark, SF_DIR).collect()} == want


def test_every_prefix_as_the_library(spark, library):
    pieces, own = library[1], prefix_tokens.counter(PIECES)
    rng = random.Random(1)
    sample = [t[:600] for t in rng.sample(sorted(texts(spark).values()), 12)]
    mixed = ["".join(rng.choice(ODD + [" ", "er", "▁", "\n"]) for _ in range(4))[:150] for _ in range(20)]
    for text in ODD + sample + mixed:
        text = text[:600]
        counts = own.counts(text)
        assert len(counts) == len(text) + 1
        assert counts == [len(pieces.encode(text[:n])) for n in range(len(text) + 1)]
        assert [counts[-1]] == own.totals([text])


def test_budget_questions_from_the_stored_counts(spark, library):
    rows = [(i, t[:400]) for i, t in enumerate(ODD)] + [(99, None)]
    counted = prefix_tokens.token_counts(docs(spark, rows), PIECES)
    from pyspark.sql import functions as F

    got = counted.select(
        "doc_id",
        prefix_tokens.tokens_at("prefix_tokens", F.lit(7)).alias("at"),
        prefix_tokens.longest_within("prefix_tokens", 5).alias("fits"),
    ).collect()
    for row in got:
        text = dict(rows)[row.doc_id] or ""
        counts = [len(library[1].encode(text[:n])) for n in range(len(text) + 1)]
        assert row.at == counts[min(7, len(text))]
        assert row.fits == max(n for n, c in enumerate(counts) if c <= 5)


def test_query_reads_the_prefix_store(spark, monkeypatch):
    from pyspark.sql import functions as F

    stores, make = [], prefix_tokens.token_counts
    monkeypatch.setattr(prefix_tokens, "token_counts", lambda *a, **k: stores.append(make(*a, **k)) or stores[-1])
    QUERIES["op6_token_counts"](spark, SF_DIR)
    sizes = stores[0].join(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id").select(
        (F.size("prefix_tokens") == F.length("text") + 1).alias("whole")
    )
    assert {r.whole for r in sizes.collect()} == {True}


def test_store_of_many_texts_and_again_from_the_cache(library):
    own, mixed = prefix_tokens.counter(PIECES), [*ODD, None, "", *reversed(ODD)]
    for _ in range(2):
        bounds, counts = own.store(mixed)
        for text, a, b in zip(mixed, bounds, bounds[1:]):
            assert counts[a] == 0 and b - a == len(text or "") + 1
            assert counts[b - 1] == len(library[1].encode(text or ""))
    assert [part.tolist() for part in own.store([])] == [[0], []]


def test_byte_bpe_as_the_library(spark, library):
    want = {
        (
            i,
            len(ids := library[0].encode_ordinary(t)),
            hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256(t.encode()).hexdigest(),
        )
        for i, t in texts(spark).items()
    }
    assert {tuple(r) for r in QUERIES["op7_byte_bpe"](spark, SF_DIR).collect()} == want


def test_byte_bpe_of_odd_texts(library):
    own = byte_bpe.tokenizer(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(2)
    mixed = ["".join(chr(rng.choice([32, 10, 97, 101, 0xE9, 0x4E2D, 0x1F600, 0xA0, 39, 49])) for _ in range(80)) for _ in range(200)]
    coded = own.encode(ODD + mixed)
    assert own.decode(coded.slice(3, 40)).to_pylist() == [text.encode() for text in (ODD + mixed)[3:43]]
    assert own.decode_by_query(coded.to_pylist()) == own.decode(coded).to_pylist()
    for text, ids, decoded in zip(ODD + mixed, coded.to_pylist(), own.decode(coded).to_pylist()):
        assert np.frombuffer(ids, "<u4").tolist() == library[0].encode_ordinary(text), text
        assert decoded == text.encode()
    for n in (2, 100, 255, 256, 257, 900):  # the recursive query and the heap agree
        piece = bytes(rng.choice(b"theraning") for _ in range(n))
        assert own._recursive([piece])[0] == own._by_heap(piece)
    assert own.decode(pa.array([b"", own.encode_pieces([b"ab\xff"])[b"ab\xff"]])).to_pylist() == [b"", b"ab\xff"]
    assert own.encode([None]).to_pylist() == own.decode(own.encode([None])).to_pylist() == [b""]
    assert own.encode([]).to_pylist() == own.decode(own.encode([])).to_pylist() == []
    with pytest.raises((ValueError, IndexError)):
        own.decode(pa.array([np.array([len(own.bytes_of) - 1, 1 << 20], "<u4").tobytes()]))


def test_decoding_sees_ids_that_are_wrong(monkeypatch):
    """Bytes come from the ids that are given out: doubled, exchanged or lost ones change them."""
    own = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    text = "the dog and the cat"
    assert own.decode(own.encode([text])).to_pylist() == [text.encode()]
    dog, cat = own.ids[" dog"], own.ids[" cat"]
    for wrong in (dog + dog, b"", cat):
        own.ids[" dog"] = wrong
        assert own.decode(own.encode([text])).to_pylist() != [text.encode()]
    own.ids[" dog"] = dog
    cut = byte_bpe._cut
    monkeypatch.setattr(byte_bpe, "_cut", lambda parts, bounds: cut(parts[::-1], bounds))  # laid out in the wrong order
    assert own.encode([text]).to_pylist() != [b""]
    wrong = own.encode([text])
    monkeypatch.undo()
    assert own.decode(wrong).to_pylist() != [text.encode()]


def test_awkward_rows(spark):
    table = clashing(awkward(spark), ["ids", "decoded", "token_ids", "round_trip", "n_tokens"])
    counted = {r.doc_id: r for r in prefix_tokens.token_counts(table, PIECES, prefixes=False).collect()}
    assert (counted[1].n_bytes, counted[1].n_tokens, counted[2].n_tokens) == (0, 0, 0)
    encoded = byte_bpe.encode_texts(table, RANKS, public_tokenizers.PATTERN)
    assert all(r.decoded.decode() == (t or "") for r, t in zip(encoded.collect(), [x.text for x in table.collect()]))
    kept = byte_bpe.with_tokens(table, RANKS, public_tokenizers.PATTERN).collect()
    assert len(kept) == table.count() and all(r.round_trip for r in kept)
    for operator in (
        lambda t: prefix_tokens.token_counts(t, PIECES),
        lambda t: byte_bpe.encode_texts(t, RANKS, public_tokenizers.PATTERN),
        lambda t: byte_bpe.with_tokens(t, RANKS, public_tokenizers.PATTERN),
    ):
        assert operator(table.limit(0)).count() == 0
