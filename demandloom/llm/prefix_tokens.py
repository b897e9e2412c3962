"""Exact token counts at every prefix, by dynamic programming over the last token.

The tokens of a prefix end in one token ``t``, and before it stand the tokens of the
shorter prefix. ``t`` is the one whose neighbour, the last token of that shorter
prefix, together with it encodes to just these two. So one pass over a text gives
the last token and the count of every prefix, and questions of truncation and
budget are answered from the stored counts without encoding again.

Made for piece vocabularies whose merges never reach across the start of a word:
a piece holds its blanks in front only. Then the pass starts anew at every word, and
the prefixes of words seen before are looked up. The vocabulary file is read in the tasks by its
path, which has to be valid on every executor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import slices

_BLANK = "▁"
_CACHED = 1 << 20
_CACHED_BYTES = 64 << 20
_PAIRS = 1 << 19
_SLICE_BYTES = 4 << 20


class PieceCounter:
    """Counts for one sentencepiece BPE vocabulary with byte fallback and a blank added in front."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ids}
        if any(_BLANK in piece.lstrip(_BLANK) for piece in self.score):
            raise ValueError("a piece of this vocabulary reaches across the start of a word")
        self.longest = max(map(len, self.score), default=1)
        # A control character outside all pieces ends a word as well.
        alone = [c for c in "\n\t\r" if not any(c in piece for piece in self.score)]
        stop = "".join(map(re.escape, alone))
        single = f"|[{stop}]" if alone else ""
        self.words = re.compile(f"{_BLANK}*[^{_BLANK}{stop}]+{single}|{_BLANK}+")
        self._number_tokens()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}  # packed counts of all prefixes of words
        self.held = 0  # bytes of them

    def _number_tokens(self) -> None:
        """Numbers of the tokens, what each is made of, and the rank of its last merge: -1 for characters.

        A piece that its own merges do not arrive at is never a token. Equal scores are equal ranks.
        """
        singles = [p for p in self.score if len(p) == 1]
        whole = [p for p in self.score if len(p) > 1 and self._merged(p)[0] == [p]]
        self.tokens = {piece: number for number, piece in enumerate([*singles, *whole])}
        places = {score: rank for rank, score in enumerate(sorted({-self.score[p] for p in self.score if len(p) > 1}))}
        self.rank = [-1] * len(singles) + [places[-self.score[p]] for p in whole]
        self.halves: list[tuple[int, int] | None] = [None] * len(singles)
        for piece in whole:
            left, right = self._merged(piece)[1]
            self.halves.append((self.tokens[left], self.tokens[right]))
        # every pair that merges, also into a piece that is no token in the end
        self.joined = {
            pair: places[-self.score[p]] for p in self.score if len(p) > 1 for pair in self._splits(p)
        }

    def _splits(self, piece: str) -> Iterator[tuple[int, int]]:
        for cut in range(1, len(piece)):
            left, right = self.tokens.get(piece[:cut]), self.tokens.get(piece[cut:])
            if left is not None and right is not None:
                yield left, right

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """``text`` by its merges, the best-scored neighbours first, of equal ones the left; and the last merge."""
        parts, last = list(text), None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def _fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay two when their texts are merged as one.

        Undoes the merges of both, the later one first, and looks whether the pieces
        that then touch would have been merged before.
        """
        key = left << 32 | right
        if (known := self.pairs.get(key)) is not None:
            return known
        joined, halves, rank, fits = self.joined, self.halves, self.rank, None
        limit = len(rank)
        while fits is None:
            if joined.get((left, right), limit) < limit:
                fits = False
            elif rank[left] > rank[right] or not halves[right]:
                if halves[left]:
                    limit, left = rank[left], halves[left][1]
                else:
                    fits = True
            else:  # of equal ranks the left merges first, so a pair across would have come before
                limit, right = rank[right] + 1, halves[right][0]
        if len(self.pairs) >= _PAIRS:
            self.pairs.clear()
        self.pairs[key] = fits
        return fits

    def _extend(self, word: str, last: list[int | None], counts: list[int]) -> None:
        """Last token and count of every prefix of ``word`` from those of a shorter prefix on."""
        tokens, longest, fits = self.tokens.get, self.longest, self._fits
        for end in range(len(last), len(word) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = tokens(word[start:end])
                if token is not None and ((before := last[start]) is None or fits(before, token)):
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
            else:  # a character outside the vocabulary: its bytes, and nothing merges with them
                last.append(None)
                counts.append(counts[-1] + len(word[end - 1].encode()))

    def learn(self, words: set[str]) -> None:
        """Counts of the prefixes of new words. In order of the alphabet, a word goes on where it parts from the one before."""
        before = ""
        last: list[int | None] = [None]
        counts = [0]
        for word in sorted(words):
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], counts[same + 1 :]
            self._extend(word, last, counts)
            self.known[word] = packed = np.array(counts[1:], dtype=np.int32).tobytes()
            self.held += len(packed)
            before = word

    def split(self, text: str | None) -> list[str]:
        return self.words.findall((_BLANK + text).replace(" ", _BLANK)) if text else []

    def store(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each text, and between them the number of tokens of its first ``n`` characters for every
        ``n`` from 0 to its length.

        Counts within a word are those of the word; what stands before it is added.
        """
        cut = [self.split(text) or [_BLANK] for text in texts]
        if len(self.known) > _CACHED or self.held > _CACHED_BYTES:
            self.known.clear()
            self.held = 0
        self.learn(set(chain.from_iterable(cut)) - self.known.keys())
        packed = [self.known[word] for words in cut for word in words]
        counts = np.frombuffer(b"".join(packed), dtype=np.int32).copy()
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ends = np.cumsum(sizes)
        own = counts[ends - 1]
        done = np.cumsum(own, dtype=np.int64) - own
        n_words = np.fromiter(map(len, cut), np.int64, len(cut))
        words = np.cumsum([0, *n_words])
        done -= np.repeat(done[words[:-1]], n_words)
        counts += np.repeat(done.astype(np.int32), sizes)
        bounds = np.concatenate([[0], ends[words[1:] - 1]])
        counts[bounds[:-1]] = 0  # the blank in front is no character of the text
        return bounds, counts

    def totals(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text."""
        bounds, counts = self.store(texts)
        return counts[bounds[1:] - 1].tolist()

    def counts(self, text: str) -> list[int]:
        """The number of tokens of ``text[:n]`` for every ``n`` from 0 to its length."""
        return self.store([text])[1].tolist()


@cache
def counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def token_counts(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = True
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, prefix_tokens)`` for every row.

    ``prefix_tokens[n]`` is the number of tokens of the first ``n`` characters; it is null
    with ``prefixes=False``, for those who want the last of them only, ``n_tokens``.

    A null text counts as empty: no bytes, no tokens, one prefix of 0 tokens. Null
    ids and repeated rows stay, an empty table gives an empty table, and further
    columns are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_file)
        for part in slices(batches, 1, _SLICE_BYTES):
            texts = [text or "" for text in part.column(1).to_pylist()]
            bounds, counts = own.store(texts)
            marks = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(counts)) if prefixes else None
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(text.encode()) for text in texts], pa.int64()),
                    pa.array(counts[bounds[1:] - 1], pa.int64()),
                    marks if prefixes else pa.nulls(len(texts), pa.list_(pa.int32())),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "prefix_tokens"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, prefix_tokens array<int>")


def tokens_at(prefix_tokens: str, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters, from the stored counts."""
    return F.element_at(prefix_tokens, F.least(n_chars + 1, F.size(prefix_tokens)))


def longest_within(prefix_tokens: str, budget: int) -> Column:
    """The most characters from the start that take no more than ``budget`` tokens.

    Counts can fall from one prefix to the next (a longer piece takes over), so the
    last prefix within the budget is taken.
    """
    return F.size(prefix_tokens) - F.array_position(F.transform(F.reverse(prefix_tokens), lambda n: n <= budget), True)
