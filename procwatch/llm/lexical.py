"""Ranked lexical search over all documents by branch and bound in document FP-trees.

Documents are restricted to the terms of the items, and their terms put in order of
frequency, so that sorted documents form a trie: a node is a range of documents that
share their most frequent terms. The largest tf of each term under a node and the
smallest m under it bound every score there. Depth first, from the most promising
child, a node is entered only for the items that it may still give one of their best.

Documents lie in shards of bounded size, one trie each; a task keeps the best of its
shards so far, and passes on a few rows per item. Items come in groups of bounded size.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from procwatch.llm import words
from procwatch.session import materialize

TOP = 10
TF_SCALE, TF_ONE, M_FACTOR = 1_000_000_000, 1000, 8
LENGTH_SHARE = 75            # percent of m that follows the length
SHARD_DOCS = 8192            # documents of a trie, at most
SHARD_ENTRIES = 1 << 21      # and their entries, but for one longer document
LEAF_DOCS = 8                # ranges of so many are scored one by one
GROUP_CHARS = 1 << 22        # characters of the items that are searched at a time
_CELLS = 1 << 21             # of the largest matrix of a task
_DEAL = 32                   # parts an item's best rows are first reduced in
_ROW_BYTES = 1 << 24


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms and where each text's terms begin: only A-Z are put in lower case."""
    data, offsets = words.text_buffer(texts)
    # the byte 0xC0 is in no text; put for 0xC3, it keeps Latin-1 letters as they are
    return words.word_hashes(np.where(data == 0xC3, np.uint8(0xC0), data), offsets)


class Items:
    """A group of items: sorted vocabulary, and (item, term, repeats) sorted by item."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        hashes, bounds = terms_of(pa.array(texts, pa.string()))
        self.vocabulary, codes = np.unique(hashes, return_inverse=True)
        n_terms = max(len(self.vocabulary), 1)
        row = np.repeat(np.arange(len(ids)), np.diff(bounds))
        keys, self.repeats = np.unique(row * n_terms + codes, return_counts=True)
        self.item, self.term = keys // n_terms, keys % n_terms


def vectors(docs: DataFrame, doc_id: str, text: str, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs): each document's number of terms, and those of the vocabulary it holds."""
    kind = docs.schema[doc_id].dataType
    id_type = to_arrow_type(kind)

    def part(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        hashes, bounds = terms_of(texts)
        n_docs, n_terms = len(ids), max(len(vocabulary), 1)
        row = np.repeat(np.arange(n_docs), np.diff(bounds))
        at = np.minimum(np.searchsorted(vocabulary, hashes), n_terms - 1)
        known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
        keys, tf = np.unique(row[known] * n_terms + at[known], return_counts=True)
        ends = np.searchsorted(keys, np.arange(n_docs + 1) * n_terms).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (keys % n_terms, tf)]
        return pa.RecordBatch.from_arrays([ids.cast(id_type), pa.array(np.diff(bounds)), *lists],
                                          names=["doc_id", "n", "terms", "tfs"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = words.text_buffer(batch.column(1))[1]
            for start, end in words.row_groups(sizes, _ROW_BYTES):
                yield part(batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start))

    return docs.select(doc_id, text).mapInArrow(
        task, f"doc_id {kind.simpleString()}, n long, terms array<int>, tfs array<int>")


def shares(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """What a term with weight 1 adds to a score; grows with tf and falls with m."""
    return (TF_SCALE * tf) // (TF_ONE * tf + M_FACTOR * m)


class Searched:
    """The best rows of each item in the shards searched so far, and how many scores that took."""

    def __init__(self, items: Items, weights: np.ndarray, top: int):
        self.n_items, self.n_terms, self.top = len(items.ids), max(len(items.vocabulary), 1), top
        self.item, self.term = items.item, items.term
        self.weight = weights[items.term] * items.repeats
        self.best: list[list[tuple]] = [[] for _ in range(self.n_items)]
        self.limit = np.ones(self.n_items, np.int64)  # what a score must reach
        self.scored = self.seen = 0

    def entries(self, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms and weights of the active items, and where each item's begin. All have terms."""
        wanted = np.zeros(self.n_items, bool)
        wanted[active] = True
        chosen = wanted[self.item]
        item = self.item[chosen]
        return self.term[chosen], self.weight[chosen], np.flatnonzero(np.diff(item, prepend=-1))

    def add(self, item: int, scores: np.ndarray, rows: np.ndarray, ids: list) -> None:
        new = [(-int(s), ids[r] is None, ids[r]) for s, r in zip(scores, rows)]
        # ids of one kind; a null id comes last and is compared with none
        self.best[item] = sorted(self.best[item] + new,
                                 key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))[:self.top]
        if len(self.best[item]) == self.top:
            self.limit[item] = max(1, -self.best[item][-1][0])


class Trie:
    """Documents of a shard, sorted by their terms from the most frequent one on."""

    def __init__(self, ids: list, m: np.ndarray, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray,
                 place: np.ndarray):
        """`place`: place of each term in order of frequency."""
        row = np.repeat(np.arange(len(ids)), np.diff(starts))
        inside = np.lexsort((place[terms], row))
        terms, tfs = terms[inside], tfs[inside]
        names = place[terms].astype(">u4").tobytes()
        keys = [names[4 * a:4 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        order = np.array(sorted(range(len(ids)), key=keys.__getitem__), np.int64)
        sizes = np.diff(starts)[order]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        moved = np.repeat(starts[:-1][order] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.terms, self.tfs = terms[moved], tfs[moved].astype(np.int64)
        self.ids, self.m = [ids[i] for i in order], m[order]
        self.sizes = sizes

    def _common(self, first: int, last: int) -> int:
        """How many leading terms two documents share: all between them share as many."""
        n = int(min(self.sizes[first], self.sizes[last]))
        a, b = self.starts[first], self.starts[last]
        unlike = np.flatnonzero(self.terms[a:a + n] != self.terms[b:b + n])
        return int(unlike[0]) if len(unlike) else n

    def children(self, a: int, b: int) -> list[tuple[int, int]]:
        """The node's ranges below; small neighbours are joined to one leaf."""
        depth = self._common(a, b - 1)
        at = self.starts[a:b] + depth
        has = self.sizes[a:b] > depth
        step = np.where(has, self.terms[np.minimum(at, len(self.terms) - 1)], -1)
        cuts = [a, *(np.flatnonzero(np.diff(step)) + 1 + a).tolist(), b]
        found, begin = [], a
        for low, high in zip(cuts[:-1], cuts[1:]):
            if high - begin > LEAF_DOCS:
                if begin < low:
                    found.append((begin, low))
                begin = low
            if high - low > LEAF_DOCS:
                found.append((low, high))
                begin = high
        if begin < b:
            found.append((begin, b))
        return found

    def alike(self, a: int, b: int) -> bool:
        return self.sizes[a] == self.sizes[b - 1] == self._common(a, b - 1)

    def bounds(self, a: int, b: int, state: Searched, active: np.ndarray) -> np.ndarray:
        """What no score of the active items in this range exceeds."""
        terms, tfs = self.terms[self.starts[a]:self.starts[b]], self.tfs[self.starts[a]:self.starts[b]]
        most = np.zeros(state.n_terms, np.int64)
        np.maximum.at(most, terms, tfs)
        term, weight, begin = state.entries(active)
        return np.add.reduceat(shares(most, self.m[a:b].min())[term] * weight, begin)

    def score(self, a: int, b: int, state: Searched, active: np.ndarray) -> None:
        """Score the documents of a range for the active items."""
        term, weight, begin = state.entries(active)
        step = max(1, _CELLS // max(state.n_terms, len(term)))
        for low in range(a, b, step):
            high = min(low + step, b)
            part = slice(self.starts[low], self.starts[high])
            row = np.repeat(np.arange(high - low), self.sizes[low:high])
            values = np.zeros((high - low, state.n_terms), np.int64)
            values[row, self.terms[part]] = shares(self.tfs[part], self.m[low:high][row])
            scores = np.add.reduceat(values[:, term] * weight, begin, axis=1)
            state.scored += scores.size
            good = scores >= state.limit[active]
            for k in np.flatnonzero(good.any(axis=0)):
                rows = np.flatnonzero(good[:, k])
                state.add(int(active[k]), scores[rows, k], rows + low, self.ids)

    def search(self, state: Searched) -> None:
        every = np.unique(state.item)
        if not len(every) or not self.ids:
            return
        state.seen += len(every) * len(self.ids)
        stack = [(0, len(self.ids), every, self.bounds(0, len(self.ids), state, every))]
        while stack:
            a, b, active, bound = stack.pop()
            open_ = bound >= state.limit[active]
            active = active[open_]
            if not len(active):
                continue
            if b - a <= LEAF_DOCS or self.alike(a, b):
                self.score(a, b, state, active)
                continue
            below = [(low, high, active, self.bounds(low, high, state, active))
                     for low, high in self.children(a, b)]
            below.sort(key=lambda node: (node[3] / state.limit[active]).max())
            stack += below


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, n, starts, terms, tfs) of so many documents at a time."""
    held, docs, entries = [], 0, 0

    def joined() -> tuple:
        whole = pa.Table.from_batches(held).combine_chunks()
        terms, tfs = (whole[c].combine_chunks() for c in ("terms", "tfs"))
        lengths = np.diff(terms.offsets.to_numpy())
        return (whole["doc_id"].to_pylist(), whole["n"].to_numpy(),
                np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
                terms.flatten().to_numpy(), tfs.flatten().to_numpy())

    for batch in batches:
        sizes = np.diff(batch["terms"].offsets.to_numpy())
        at = 0
        while at < batch.num_rows:
            upto = np.searchsorted(np.cumsum(sizes[at:]), SHARD_ENTRIES - entries, side="right")
            take = int(min(max(upto, 0 if held else 1), SHARD_DOCS - docs, batch.num_rows - at))
            if take:
                held.append(batch.slice(at, take))
                docs, entries, at = docs + take, entries + int(sizes[at:at + take].sum()), at + take
            if at < batch.num_rows:
                yield joined()
                held, docs, entries = [], 0, 0
    if held:
        yield joined()


def _search_group(docs: DataFrame, doc_id: str, text: str, items: Items, item_type: DataType, top: int) -> DataFrame:
    found = materialize(vectors(docs, doc_id, text, items.vocabulary), "lexical-vectors")
    n_docs, n_terms = found.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    n_terms = n_terms or 1
    df = np.zeros(max(len(items.vocabulary), 1), np.int64)
    counts = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for row in counts.toLocalIterator():  # one row per term of the group, at most
        df[row["term"]] = row["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    place = np.empty(len(df), np.int64)
    place[np.argsort(-df, kind="stable")] = np.arange(len(df))
    kind = found.schema["doc_id"].dataType
    id_type, item_id_type = to_arrow_type(kind), to_arrow_type(item_type)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Searched(items, weights, top)
        for ids, n, starts, terms, tfs in _shards(batches):
            m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_terms
            Trie(ids, m, starts, terms, tfs, place).search(state)
        rows = [(item, items.ids[item], doc, -score) for item, best in enumerate(state.best) for score, _, doc in best]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], item_id_type),
             pa.array(columns[2], id_type), pa.array(columns[3], pa.int64())],
            names=["item", "item_id", "doc_id", "score"])

    hits = found.where(F.size("terms") > 0).mapInArrow(
        task, f"item int, item_id {item_type.simpleString()}, doc_id {kind.simpleString()}, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(_DEAL))).orderBy(*order)
    few = hits.withColumn("_at", F.row_number().over(part)).where(F.col("_at") <= top).drop("_at")
    return (few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
            .where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """The `top` best documents of each item with a score above 0: (item_id, rank, doc_id, score).

    Rows are counted whole, however long. A null or empty text has no terms: such an item finds
    nothing, such a document is not found and not counted. Equal scores go to the smaller id, a
    null id last; repeated documents take a rank each, repeated items are searched each. No
    documents or items give no rows. Other columns are not looked at. The driver holds the items
    of one group at a time, some `GROUP_CHARS` characters or one longer item.
    """
    chars = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    n_groups = max(1, math.ceil(chars / GROUP_CHARS))
    wanted = items.select(F.col(item_id).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    group = F.pmod(F.xxhash64("id", "text"), F.lit(n_groups))
    kind, results = items.schema[item_id].dataType, []
    for g in range(n_groups):
        rows = wanted.where(group == g).collect()
        results.append(_search_group(docs, doc_id, text, Items([r["id"] for r in rows], [r["text"] for r in rows]),
                                     kind, top))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found
