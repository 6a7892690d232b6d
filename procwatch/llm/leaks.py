"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters leaks into a document if some passage of the document is
within k = floor(m * ERROR_RATE) edits of it. Cut into k + 1 pieces, one piece of the
item must then stand in that passage unchanged. An Aho-Corasick automaton finds all
pieces of all items in one run over a whole document; around each hit, Myers' bit-parallel
algorithm finds the passage with the smallest distance.

Both sides are compared as lower-case words with one blank between, as bytes.

Documents are read once for each block of items of BLOCK_CHARS characters; a task holds
one block's automaton. Documents never meet each other, so no key is hot.
"""

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ERROR_RATE = 0.05
MIN_WORDS = 5
MIN_WIDTH = 20   # of items of fewer words: scripts without blanks have few words at any length
BLOCK_CHARS = 4_000_000


def _table() -> bytes:
    return bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


_WORDS_ONLY = _table()


def normal(text: str | None) -> str:
    """Lower-case words with a blank between, one character for each byte."""
    return b" ".join((text or "").lower().encode().translate(_WORDS_ONLY).split()).decode("latin-1")


def width(text: str | None) -> int:
    """Letters and digits of a text; ideographs and other wide characters count two."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text or "" if c.isalnum())


@dataclass
class Item:
    """A test item, its error budget, its pieces and where they begin."""

    item_id: int | None
    text: str
    budget: int
    pieces: list[tuple[int, str]]


def make_item(item_id: int | None, text: str | None, error_rate: float = ERROR_RATE,
              min_words: int = MIN_WORDS) -> Item | None:
    """None for an item that is too short in words and in width: many documents would have it by chance."""
    words = normal(text)
    if not words or words.count(" ") + 1 < min_words and width(text) < MIN_WIDTH:
        return None
    budget = int(len(words) * error_rate)
    cuts = [len(words) * i // (budget + 1) for i in range(budget + 2)]
    return Item(item_id, words, budget, [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])])


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _columns(masks: dict[str, int], m: int, text: str, anchored: bool) -> Iterator[int]:
    """Distance of the pattern to the best passage that ends at each character of the text.

    `anchored` passages begin at the text's first character.
    """
    every, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance, carry = every, 0, m, int(anchored)
    for c in text:
        equal = masks.get(c, 0)
        across = (((equal & plus) + plus) ^ plus) | equal | minus
        grow, shrink = minus | ~(across | plus), plus & across
        distance += bool(grow & top) - bool(shrink & top)
        grow, shrink = (grow << 1) | carry, shrink << 1
        # a pattern's first row grows along an anchored text and is 0 along a free one
        vertical = equal | minus
        plus = (shrink | ~(vertical | grow)) & every
        minus = grow & vertical & every
        yield distance


def best_passage(item: Item, text: str, low: int, high: int) -> tuple[int, int, int] | None:
    """(distance, begin, end) of the nearest passage within text[low:high], if within the budget.

    Of equally near passages the one that ends first, and of these the longest.
    """
    m, best, end = len(item.text), item.budget + 1, 0
    for i, d in enumerate(_columns(_masks(item.text), m, text[low:high], False)):
        if d < best:
            best, end = d, low + i + 1
    if best > item.budget:
        return None
    back = text[max(low, end - m - best):end][::-1]
    begin = end
    for i, d in enumerate(_columns(_masks(item.text[::-1]), m, back, True)):
        if d == best:
            begin = end - i - 1
    return best, begin, end


class Matcher:
    """Finds the items of one block in documents."""

    def __init__(self, items: list[Item]) -> None:
        import ahocorasick
        self.items = items
        where: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(items):
            for at, piece in item.pieces:
                where.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.any = bool(where)

    def passages(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item number, distance, begin, end, first word) of the nearest passage of each leaked item."""
        words = normal(text)
        if not words or not self.any:
            return []
        windows: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.automaton.iter(words):
            for n, at in places:
                item = self.items[n]
                low = max(0, last + 1 - size - at - item.budget)
                high = min(len(words), last + 1 - size - at + len(item.text) + item.budget)
                mine = windows.setdefault(n, [])
                # hits of one passage overlap: look at their union once
                if mine and low <= mine[-1][1] and low >= mine[-1][0]:
                    mine[-1][1] = max(mine[-1][1], high)
                else:
                    mine.append([low, high])
        found = []
        for n, mine in windows.items():
            near = [p for p in (best_passage(self.items[n], words, a, b) for a, b in mine) if p]
            if near:
                distance, begin, end = min(near)
                found.append((n, distance, begin, end, words.count(" ", 0, begin)))
        return found


def item_blocks(benchmark: DataFrame, item_id: str, text: str, error_rate: float, min_words: int,
                block_chars: int = BLOCK_CHARS) -> Iterator[list[Item]]:
    """The items, block by block; the driver holds one block at a time."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(chars // block_chars) + 1
    for n in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == n).distinct().collect()
        made = [make_item(r["item_id"], r["text"], error_rate, min_words)
                for r in sorted(mine, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))]
        yield [item for item in made if item]


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE,
               min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, budget, first_word, last_word: the nearest passage of each leak.

    Null and empty texts, on either side, and items of fewer than `min_words` words and a width
    of less than `MIN_WIDTH` match nothing. Repeated documents are reported one by one; of repeated items with one id each
    text that leaks is reported. Null ids are reported as null. Words are runs of letters and
    digits, counted from 0. Other columns are not read. No documents or items give no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, distance long, budget long, first_word long, last_word long"
    names = [f.split()[0] for f in schema.split(", ")]

    def searched(items: list[Item]) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items)
            for batch in batches:
                out = []
                for doc, content in zip(batch["doc_id"].to_pylist(), batch["text"]):
                    for n, distance, begin, end, first in matcher.passages(content.as_py()):
                        item = matcher.items[n]
                        words = matcher_words(content.as_py(), begin, end)
                        out.append((doc, item.item_id, distance, item.budget, first, first + words - 1))
                columns = list(zip(*out)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
        return rows.mapInArrow(search, schema)

    return reduce(DataFrame.unionAll, [searched(items) for items in item_blocks(
        benchmark, item_id, item_text, error_rate, min_words, block_chars)])


def matcher_words(text: str | None, begin: int, end: int) -> int:
    return normal(text)[begin:end].strip().count(" ") + 1


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs`, with all their columns, into which no item leaks."""
    position = docs.columns.index(text)

    def cleaned(rows: DataFrame, items: list[Item]) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items)
            for batch in batches:
                clean = [not matcher.passages(t.as_py()) for t in batch.column(position)]
                yield batch.filter(pa.array(clean, pa.bool_()))
        return rows.mapInArrow(keep, rows.schema)

    return reduce(cleaned, item_blocks(benchmark, item_id, item_text, error_rate, min_words, block_chars), docs)
