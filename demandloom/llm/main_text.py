"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A block is main text or not. Its score is the sum of the weights of its features: the tags, class
names, ids and roles of the elements around it, and counts of its text. Neighbouring blocks
are tied by transitions, of their own for blocks of one parent element and of one tag. Viterbi
decoding gives the best labels of a page as a whole.

The field is trained on labelled pages: pages of known layout (:mod:`layouts`) written with
words of the corpus, and up to ``SAMPLE_PAGES`` pages of the corpus, taken by the hash of
their id, that have exactly one ``article`` or ``main`` element, whose blocks are their
main text. Both are bounded parameters; every page is extracted whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from demandloom.llm.common import slices
from demandloom.llm.html_blocks import Block, leaf_blocks, own_words, parent_words
from demandloom.llm.layouts import labelled_page

SAMPLE_PAGES = 150
SAMPLE_CHARS = 20_000
LAYOUTS = 1200
STEPS = 90
RIDGE = 0.3
# Words of layouts where the corpus has none.
FILLER = "of the and to in a is that for it as was with be by on not he this are or from at which an have had but all you".split()


def _log(n: int) -> int:
    return n.bit_length()


def text_features(text: str, links: int, tag: str) -> tuple[str, ...]:
    """Features of a block's own text; few different ones, so that they are weighed by table."""
    words = text.count(" ") + 1
    size, linked = min(_log(words), 8), 0 if not links else 1 if 4 * links < len(text) else 2 if 5 * links < 4 * len(text) else 3
    ending = text[-1]
    end = "s" if ending in ".!?…。" else "c" if ending in ",;:" else "a" if ending.isalnum() else "o"
    marks = min(_log(text.count(",") + text.count(". ")), 5)
    digits = sum(map(text.count, "0123456789"))
    number = 0 if not digits else 1 if 8 * digits < len(text) else 2
    sign = "©" in text or "(c)" in text
    split = "|" in text or "»" in text or "·" in text or "›" in text
    return _text_features(tag, size, linked, end, marks, number, sign, split)


@lru_cache(1 << 14)
def _text_features(tag: str, size: int, linked: int, end: str, marks: int, number: int, sign: bool, split: bool) -> tuple[str, ...]:
    sized = [f"size>{i}" for i in range(1, size)]
    marked = [f"marks>{i}" for i in range(marks)]
    out = ["bias", *sized, *marked, f"link {linked}", f"end {end}", f"digit {number}", f"{tag} link {linked}", f"size {size} end {end}", f"size {size} link {linked}"]
    return (*out, *(["sign"] if sign else []), *(["split"] if split else []))


def features(block: Block) -> tuple[str, ...]:
    return (*block.place, *block.own, *block.parent, *text_features(block.text, block.links, block.tag))


class Field:
    """Weights: ``words`` by feature for main text, ``moves[tie][from][to]``, ``first`` and ``last`` by label."""

    def __init__(self, words: dict[str, float], moves: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.words = words
        self.moves, self.first, self.last = moves.tolist(), first.tolist(), last.tolist()
        self._known: dict[tuple, float] = {}

    def _sum(self, words: Iterable[str]) -> float:
        get = self.words.get
        return sum([get(word, 0.0) for word in words])

    def _own(self, words: tuple[str, ...]) -> float:
        return self._sum(own_words(words))

    def _parent(self, words: tuple[str, ...]) -> float:
        return self._sum(parent_words(words))

    def main_blocks(self, page: str) -> list[str]:
        """Texts of the blocks that are main text, in page order."""
        blocks = leaf_blocks(page, self._sum, self._own, self._parent, 0.0)
        if not blocks:
            return []
        known = self._known
        back: list[tuple[int, int]] = []
        costs = None
        for block in blocks:
            words = text_features(block.text, block.links, block.tag)
            if (text := known.get(words)) is None:
                text = known[words] = self._sum(words)
            score = block.place + block.own + block.parent + text
            if costs is None:
                costs = [self.first[0], self.first[1] + score]
                continue
            (a, b), (c, d) = self.moves[block.tie]
            other, main = costs
            came = (int(main + c > other + a), int(main + d > other + b))
            back.append(came)
            costs = [max(other + a, main + c), max(other + b, main + d) + score]
        at = int(costs[1] + self.last[1] > costs[0] + self.last[0])
        labels = [at]
        for came in reversed(back):
            at = came[at]
            labels.append(at)
        return [block.text for block, label in zip(blocks, reversed(labels)) if label]


def train(pages: Iterable[tuple[list[Block], list[bool]]], steps: int = STEPS, ridge: float = RIDGE) -> Field:
    """The field of greatest likelihood less a ridge, for pages of blocks (with plain words) and their labels."""
    pages = sorted((page for page in pages if page[0]), key=lambda page: -len(page[0]))
    number: dict[str, int] = {}
    ids, owner = [], []
    starts = np.cumsum([0, *(len(blocks) for blocks, _ in pages)])
    for (blocks, _), start in zip(pages, starts):
        for i, block in enumerate(blocks):
            found = [number.setdefault(word, len(number)) for word in features(block)]
            ids.extend(found)
            owner.extend([start + i] * len(found))
    ids, owner = np.array(ids, dtype=np.int32), np.array(owner, dtype=np.int32)
    n, n_blocks = len(number), int(starts[-1])
    label = np.array([x for _, labels in pages for x in labels], dtype=np.int64)
    tie = np.array([b.tie for blocks, _ in pages for b in blocks], dtype=np.int64)
    lengths = np.diff(starts)
    # Pages by falling length: at block t the pages still open are the first ones.
    place = [starts[:-1][lengths > t] + t for t in range(int(lengths.max(initial=0)))]
    ends = starts[1:] - 1

    def one_hot(kinds: tuple[int, ...], *at: np.ndarray) -> np.ndarray:
        out = np.zeros(kinds)
        np.add.at(out, at, 1.0)
        return out

    inner = np.ones(n_blocks, dtype=bool)
    inner[starts[:-1]] = False
    after = np.flatnonzero(inner)
    seen = np.concatenate(
        [
            np.bincount(ids, weights=label[owner], minlength=n),
            one_hot((3, 2, 2), tie[after], label[after - 1], label[after]).ravel(),
            one_hot((2,), label[starts[:-1]]),
            one_hot((2,), label[ends]),
        ]
    )
    weights = np.zeros(n + 16)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        score = np.bincount(owner, weights=weights[ids], minlength=n_blocks)
        moves, first, last = weights[n : n + 12].reshape(3, 2, 2), weights[n + 12 : n + 14], weights[n + 14 :]
        gain = np.column_stack([np.zeros(n_blocks), score])
        forth, back = np.zeros((n_blocks, 2)), np.zeros((n_blocks, 2))
        for t, at in enumerate(place):
            if not t:
                forth[at] = first + gain[at]
                continue
            ways = forth[at - 1][:, :, None] + moves[tie[at]]
            forth[at] = np.logaddexp(ways[:, 0], ways[:, 1]) + gain[at]
        back[ends] = last
        for at in reversed(place[1:]):
            ways = moves[tie[at]] + (gain[at] + back[at])[:, None, :]
            back[at - 1] = np.logaddexp(ways[:, :, 0], ways[:, :, 1])
        total = np.repeat(np.logaddexp(*(forth[ends] + last).T), lengths)
        share = np.exp(forth + back - total[:, None])
        pair = np.exp(forth[after - 1][:, :, None] + moves[tie[after]] + (gain[after] + back[after])[:, None, :] - total[after][:, None, None])
        moved = np.zeros((3, 2, 2))
        np.add.at(moved, tie[after], pair)
        expected = np.concatenate(
            [np.bincount(ids, weights=share[owner, 1], minlength=n), moved.ravel(), share[starts[:-1]].sum(axis=0), share[ends].sum(axis=0)]
        )
        slope = expected - seen + ridge * weights
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        rate = 0.15 if step < 0.7 * steps else 0.05
        weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    words = {word: float(weights[i]) for word, i in number.items() if abs(weights[i]) > 1e-3}
    return Field(words, weights[n : n + 12].reshape(3, 2, 2), weights[n + 12 : n + 14], weights[n + 14 :])


def by_article(page: str) -> tuple[list[Block], list[bool]] | None:
    """Blocks and labels of a page whose markup says what is main text: one ``article``, or else one ``main``."""
    low = page.lower()
    for tag in ("article", "main"):
        if low.count(f"<{tag}>") + low.count(f"<{tag} ") == 1:
            blocks = leaf_blocks(page)
            apart = {f"t:{other}" for other in ("nav", "aside", "form", "footer", "button")}
            return blocks, [f"t:{tag}" in b.place and apart.isdisjoint(b.place) for b in blocks]
    return None


def labelled_pages(sampled: list[str], layouts: int = LAYOUTS) -> list[tuple[list[Block], list[bool]]]:
    """Blocks and labels of the sampled pages that mark their article, and of ``layouts`` pages of known layout."""
    out, words = [], []
    for page in sampled:
        words += [word for block in leaf_blocks(page) for word in block.text.split()[:200]]
        if marked := by_article(page):
            out.append(marked)
    for seed in range(layouts):
        page, labels = labelled_page(words or FILLER, seed)
        out.append((leaf_blocks(page), labels))
    return out


def learn_field(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES, layouts: int = LAYOUTS) -> Field:
    """A field for ``pages``, from at most ``sample_pages`` of them of up to ``SAMPLE_CHARS`` characters.

    Without such pages (an empty table, null texts) it learns from the known layouts alone.
    """
    most = 1 << 31
    share = min(1.0, 4 * sample_pages / max(1, pages.count()))  # so few go to the driver, however many tasks there are
    mark = F.xxhash64(F.col(id_col), F.col(html_col))
    usable = pages.where(F.length(html_col).between(1, SAMPLE_CHARS)).select(mark.alias("mark"), F.col(html_col).alias("html"))
    few = usable.where(F.pmod("mark", F.lit(most)) < int(share * most)).groupBy("mark").agg(F.any_value("html").alias("html"))
    sample = few.orderBy("mark").limit(sample_pages)
    return train(labelled_pages([row.html for row in sample.collect()], layouts))


def extract_main_text(pages: DataFrame, field: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text)`` for every row: the blocks of main text, joined by line ends.

    A null or empty page, and one without main text, has an empty text. Null ids, repeated rows and null urls stay, an
    empty table gives an empty table, further columns are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            texts = ["\n".join(field.main_blocks(page)) if page else "" for page in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], schema=arrow)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [(name, rows.schema[name].dataType) for name in ("page_id", "url")]
    arrow = pa.schema([*((name, to_arrow_type(kind)) for name, kind in kinds), ("text", pa.string())])
    return rows.mapInArrow(each, ", ".join(f"{name} {kind.simpleString()}" for name, kind in kinds) + ", text string")
