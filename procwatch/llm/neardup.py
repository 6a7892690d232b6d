"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles, weight = occurrences times
inverse document frequency, capped where a shingle is in fewer than a tenth of all
documents. Consistent weighted sampling draws one (shingle, level) pair per hash such
that two documents draw the same with the probability of their weighted Jaccard
similarity. `ROWS` draws make a band; documents that agree in a band are candidates, and
those whose exact weighted Jaccard similarity is `SIMILARITY` or more are linked.

Document frequencies are exact where they matter. Only shingles in a tenth of all
documents are below the cap, and there are at most ten times as many of these as an
average document has. They are found in two passes: counts of hash buckets first, then
exact counts of the shingles in buckets that are large enough.

Groups may be large. Copies with equal words are one node. Nodes of a band first meet
two centres of it, the most central and the smallest, which links nearly all of a group
in linear work. Then nodes of a band in different components meet, if what each of them
shares with any other candidate, by classes of shingles, leaves room for the similarity;
with that every candidate pair has been compared, shown to be too different, or lies in one
component anyway.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from procwatch.llm.components import components
from procwatch.llm.inputs import numbered_columns
from procwatch.llm.words import mixed, row_groups, shingles, text_buffer, word_hashes
from procwatch.session import materialize

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 3
CAP = 0.1           # share of documents below which all shingles weigh the same
BUCKETS = 1 << 16
CLASSES = 64        # of shingles, by which a pair's intersection is bounded
_STEP_BYTES = 1 << 18
_SEED = 0x5DEECE66D


@dataclass
class Weights:
    """Inverse document frequency relative to the cap, of the shingles that are below it."""

    heavy: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def of(self, shingle: np.ndarray, times: np.ndarray) -> np.ndarray:
        weight = times.astype(np.float64)
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, shingle), len(self.heavy) - 1)
            weight[self.heavy[at] == shingle] *= self.idf[at[self.heavy[at] == shingle]]
        return weight


def relative_idf(df: np.ndarray, documents: int) -> np.ndarray:
    """1 + ln((1 + N) / (1 + df)), capped, divided by the cap."""
    cap = 1 + math.log(1 / CAP)
    return np.minimum(1 + np.log((1 + documents) / (1 + np.asarray(df, np.float64))), cap) / cap


def counted_shingles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, tuple]]:
    """For some rows at a time: first row, row after the last, and for each different shingle of a
    row the row, the shingle and its occurrences; then all words and where each row's begin."""
    data, offsets = text_buffer(column)
    for start, end in row_groups(offsets, _STEP_BYTES):
        low = int(offsets[start])
        words, bounds = word_hashes(data[low:int(offsets[end])], offsets[start:end + 1] - low)
        found, row, _ = shingles(words, bounds, SHINGLE)
        order = np.lexsort((found, row))
        found, row = found[order], row[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(found)))
        yield start, end, row[first], found[first], times, (words, bounds)


def node_keys(words: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits of each row's word sequence; none for a row without words."""
    place = (np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))).astype(np.uint64)
    keys = []
    for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
        each = mixed(words * salt + mixed(place + salt))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        keys.append(mixed(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))
    both = np.stack(keys, 1).astype(">u8")
    return [both[i].tobytes() if bounds[i + 1] > bounds[i] else None for i in range(len(bounds) - 1)]


class Sampler:
    """Consistent weighted sampling. Gamma variates come from tables of their quantiles, indexed by
    bits of the hash of shingle and draw, which keeps them the same for all documents."""

    def __init__(self, draws: int) -> None:
        rng = np.random.default_rng(_SEED)
        gamma = np.sort(rng.gamma(2.0, 1.0, 1 << 20))
        self.r = gamma[(np.arange(1 << 12) * 256 + 128)]
        self.inverse = 1 / self.r
        self.ln_c = np.log(gamma[np.arange(1 << 16) * 16 + 8])
        self.seeds = mixed(np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(_SEED))

    def draws(self, row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        """One value per row and draw, (rows, draws); rows without shingles have zeros."""
        out = np.zeros((rows, len(self.seeds)), np.uint64)
        if not len(row):
            return out
        firsts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        present = row[firsts]
        group = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(row))))
        ln_w = np.log(weight)
        for k, seed in enumerate(self.seeds):
            h = (shingle ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
            i = (h & np.uint64(0xFFF)).astype(np.intp)
            beta = ((h >> np.uint64(32)) & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0 ** -32
            t = np.floor(ln_w * self.inverse[i] + beta)
            ln_a = self.ln_c[((h >> np.uint64(12)) & np.uint64(0xFFFF)).astype(np.intp)] - self.r[i] * (t - beta + 1)
            least = np.minimum.reduceat(ln_a, firsts)
            at = np.flatnonzero(ln_a == least[group])
            at = at[np.concatenate([[True], group[at][1:] != group[at][:-1]])]
            out[present, k] = mixed(shingle[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out


def band_keys(draws: np.ndarray) -> np.ndarray:
    """One key per row and band, (rows, BANDS)."""
    keys = np.zeros((len(draws), BANDS), np.uint64)
    for j in range(ROWS):
        keys = mixed(keys ^ (draws[:, j::ROWS][:, :BANDS] + np.uint64(j)))
    return keys + np.arange(BANDS, dtype=np.uint64)


def document_frequencies(texts: DataFrame) -> Weights:
    """Weights of the shingles in at least a tenth of all texts. Driver: these, and bucket numbers."""
    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, documents = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            documents += batch.num_rows
            for _, _, _, found, _, _ in counted_shingles(batch.column(0)):
                counts += np.bincount((found & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(at, -1), pa.int64()),
                                          "n": pa.array(np.append(counts[at], documents), pa.int64())})

    sums = materialize(texts.mapInArrow(buckets, "bucket long, n long").groupBy("bucket")
                       .agg(F.sum("n").alias("n")), "shingle-buckets")
    total = sums.where("bucket = -1").collect()
    documents = total[0]["n"] if total else 0
    limit = CAP * (1 + documents) - 1
    large = np.array(sorted(r["bucket"] for r in sums.where((F.col("bucket") >= 0) & (F.col("n") > limit)).collect()),
                     np.int64)
    if not len(large):
        return Weights()
    wanted = np.zeros(BUCKETS, bool)
    wanted[large] = True

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [found[wanted[(found & np.uint64(BUCKETS - 1)).astype(np.int64)]]
                    for _, _, _, found, _, _ in counted_shingles(batch.column(0))]
            values, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *kept]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(values.view(np.int64)), "n": pa.array(n, pa.int64())})

    rows = (texts.mapInArrow(exact, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
            .where(F.col("n") > limit).collect())
    heavy = np.array([r["shingle"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(heavy)
    return Weights(heavy[order], relative_idf(np.array([r["n"] for r in rows])[order], documents))


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, digest, node, total weight and bands of each document (columns doc_id, digest, text)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(BANDS * ROWS)
        for batch in batches:
            nodes, totals, bands = [], [], []
            for start, end, row, found, times, (words, bounds) in counted_shingles(batch["text"]):
                weight = weights.of(found, times)
                nodes += node_keys(words, bounds)
                totals.append(np.bincount(row, weight, minlength=end - start)[:end - start])
                bands.append(band_keys(sampler.draws(row, found, weight, end - start)))
            flat = np.concatenate([np.zeros((0, BANDS), np.uint64), *bands])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["digest"], pa.array(nodes, pa.binary()),
                 pa.array(np.concatenate([np.zeros(0), *totals])),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, BANDS), pa.int32()),
                                          pa.array(flat.ravel().view(np.int64)))],
                names=["doc_id", "digest", "node", "total", "bands"])
    return docs.mapInArrow(sign, "doc_id long, digest binary, node binary, total double, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, weights: Weights) -> DataFrame:
    """node, shingles (sorted, 8 bytes each), weights (4 bytes each) and weight by class of the wanted
    documents."""
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_sets, found_weights, by_class = [], [], []
            for start, end, row, found, times, _ in counted_shingles(batch["text"]):
                weight = weights.of(found, times).astype("<f4")
                cuts = np.searchsorted(row, np.arange(end - start + 1))
                for a, b in zip(cuts, cuts[1:]):
                    found_sets.append(found[a:b].astype("<u8").tobytes())
                    found_weights.append(weight[a:b].tobytes())
                    by_class.append(np.bincount((found[a:b] % np.uint64(CLASSES)).astype(np.int64),
                                                weight[a:b], minlength=CLASSES))
            yield pa.RecordBatch.from_arrays(
                [batch["node"], pa.array(found_sets, pa.binary()), pa.array(found_weights, pa.binary()),
                 pa.array(by_class, pa.list_(pa.float64()))],
                names=["node", "shingles", "weights", "classes"])
    same = wanted.select("node", F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    one = Window.partitionBy("doc_id", "digest").orderBy(F.lit(1))  # rows may repeat an id and text
    return (docs.join(same, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id")))
            .withColumn("n", F.row_number().over(one)).where("n = 1").select("node", "text")
            .mapInArrow(collect, "node binary, shingles binary, weights binary, classes array<double>"))


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of smaller weights over sum of larger ones; both sides sorted by shingle."""
    at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    same = (b[at] == a) if len(b) else np.zeros(len(a), bool)
    shared = float(np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64))
    union = float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64)) - shared
    return shared / union if union > 0 else 0.0


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar enough, with their similarity."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, scores = [], []
            parts = [batch[c] for c in ("a_set", "a_weights", "b_set", "b_weights")]
            for i in range(batch.num_rows):
                a, wa, b, wb = (np.frombuffer(p[i].as_buffer(), kind)
                                for p, kind in zip(parts, ("<u8", "<f4", "<u8", "<f4")))
                score = weighted_jaccard(a, wa, b, wb)
                if score >= similarity - 1e-9:
                    kept.append(i)
                    scores.append(score)
            some = batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(scores, pa.float64())],
                                             names=["a", "b", "similarity"])
    side = {s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"{s}_set"),
                           F.col("weights").alias(f"{s}_weights")) for s in "ab"}
    return (pairs.join(side["b"], "b").join(side["a"], "a")
            .select("a", "b", "a_set", "a_weights", "b_set", "b_weights")
            .mapInArrow(compare, "a binary, b binary, similarity double"))


def _shared(sets: DataFrame) -> DataFrame:
    """node, and `classes`, by class the weight of its shingles that another candidate has too.

    What two candidates have in common is at most the smaller of the two, summed over classes.
    """
    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = np.frombuffer(batch["shingles"][i].as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch["node"][i].as_py()] * len(found), pa.binary()), pa.array(found),
                     pa.array(np.frombuffer(batch["weights"][i].as_buffer(), "<f4"))],
                    names=["node", "shingle", "weight"])
    each = sets.select("node", "shingles", "weights").mapInArrow(flat, "node binary, shingle long, weight float")
    # a shingle of one candidate alone adds to no intersection
    alone = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.first("node").alias("node"),
                                        F.first("weight").alias("weight")).where("n = 1")
    number = F.col("shingle").bitwiseAND(F.lit(CLASSES - 1)).cast("int")
    sums = (alone.groupBy("node", number.alias("class")).agg(F.sum("weight").alias("w"))
            .groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("class", "w"))).alias("alone")))
    left = F.transform("classes", lambda w, i: F.greatest(
        w - F.coalesce(F.try_element_at("alone", i), F.lit(0.0)), F.lit(0.0)))
    return sets.select("node", "classes").join(sums, "node", "left").select("node", left.alias("classes"))


def _room(similarity: float):
    """The intersection that a pair of these totals needs: s / (1 + s) of their sum; a little less,
    as sums are rounded."""
    return (F.col("a_total") + F.col("b_total")) * F.lit(similarity / (1 + similarity) * (1 - 1e-5))


def links(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Signatures of all documents (doc_id, digest, text), and node and label of linked nodes."""
    weights = document_frequencies(docs.select("text"))
    signed = materialize(signatures(docs, weights), "signatures")
    # documents with equal words have equal bands, so any of them stands for the node
    nodes = (signed.where("node IS NOT NULL").groupBy("node")
             .agg(F.min(F.struct("doc_id", "digest", "total", "bands")).alias("one"))
             .select("node", "one.*"))
    nodes = materialize(nodes, "nodes")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = materialize(banded.join(shared, ["band", "key"]), "band-members")
    wanted = member.select("node").distinct().join(nodes.select("node", "doc_id", "digest", "total"), "node")
    wanted = materialize(wanted, "candidates")
    sets = materialize(_sets(docs, wanted, weights), "sets")
    classes = materialize(_shared(sets), "shared-classes")
    total = F.aggregate("classes", F.lit(0.0), lambda x, y: x + y)
    facts = (wanted.select("node", "total").join(classes.select("node", total.alias("shared")), "node"))
    # a node without enough in common with any other candidate has no partner
    facts = materialize(facts.where(F.col("shared") >= F.col("total") * (similarity * (1 - 1e-5))), "facts")
    central = member.groupBy("node").agg(F.sum("n").alias("central"))
    live = materialize(member.join(facts, "node").join(central, "node")
                       .select("band", "key", "node", "total", "shared", "central"), "live-members")

    def facts_of(side: str) -> list:
        return [F.col(c).alias(f"{side}_{c}" if c != "node" else side) for c in ("node", "total", "shared")]

    most = F.max(F.struct(F.col("central"), F.col("shared"), F.col("node"), F.col("total"))).alias("most")
    least = F.min(F.struct(F.col("node"), F.col("total"), F.col("shared"))).alias("least")
    centres = live.groupBy("band", "key").agg(most, least)
    both = live.join(centres, ["band", "key"])
    star = (both.select(*facts_of("a"), F.explode(F.array(
                F.struct("most.node", "most.total", "most.shared"),
                F.struct("least.node", "least.total", "least.shared"))).alias("c"))
            .select("a", "a_total", "a_shared", F.col("c.node").alias("b"), F.col("c.total").alias("b_total"),
                    F.col("c.shared").alias("b_shared"))
            .where((F.col("a") != F.col("b")) & (F.least("a_shared", "b_shared") >= _room(similarity)))
            .select("a", "b").distinct())
    first = materialize(_verified(star, sets, similarity), "star-links")
    label = components(first)
    labelled = live.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = (labelled.groupBy("band", "key").agg(F.min("label").alias("x"), F.max("label").alias("y"))
             .where("x <> y").select("band", "key"))
    rest = materialize(labelled.join(split, ["band", "key"]).join(classes, "node")
                       .join(nodes.select("node", "bands"), "node"), "open-members")

    def side(s: str) -> DataFrame:
        return rest.select(*[F.col(c).alias(f"{s}_{c}" if c != "node" else s) for c in (
            "band", "key", "node", "total", "shared", "label", "classes", "bands")])

    # the sums by class are looked at last, and a pair counts in the first of its bands only
    agree = F.zip_with("a_bands", "b_bands", lambda x, y: x == y)
    common = F.aggregate(F.zip_with("a_classes", "b_classes", lambda x, y: F.least(x, y)), F.lit(0.0), lambda x, y: x + y)
    cross = (side("a").join(side("b"), (F.col("a_band") == F.col("b_band")) & (F.col("a_key") == F.col("b_key"))
                            & (F.col("a_label") < F.col("b_label"))
                            & (F.least("a_shared", "b_shared") >= _room(similarity))
                            & (F.array_position(agree, F.lit(True)) == F.col("a_band") + 1)
                            & (common >= _room(similarity)))
             .select("a", "b"))
    second = materialize(_verified(cross, sets, similarity), "cross-links")
    return signed, components(first.unionByName(second))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
            similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, digest (of the text), class_id, class_size, and `kept`, true for one document of each class.

    A class is a connected component of links; its id is its smallest doc_id. Texts with
    equal words in a row are copies. A text of fewer than five words is one shingle. Null texts and texts
    without words are compared with none: each is a class of its own. Null ids come last: a class has a
    null id only if all its ids are null. Rows that repeat an id and a text are copies of each
    other and are all reported; both are `kept` if one is. Extra columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("digest"), F.col(text).alias("text"))
    signed, label = links(rows, similarity)
    of_node = (signed.where("node IS NOT NULL").groupBy("node")
               .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("least"),
                    F.count(F.lit(1)).alias("n"))
               .join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    of_node = materialize(of_node, "node-labels")
    of_label = of_node.groupBy("label").agg(F.min("least").alias("first"), F.sum("n").alias("class_size"))
    of_class = of_node.select("node", "label").join(of_label, "label").select("node", "first", "class_size")
    return (signed.select("doc_id", "digest", "node").join(of_class, "node", "left")
            .select("doc_id", "digest",
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
                    F.coalesce("class_size", F.lit(1)).alias("class_size"),
                    (F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
                                               & (F.col("digest") == F.col("first.digest")))).alias("kept")))


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                        similarity: float = SIMILARITY) -> DataFrame:
    """One row of `docs` of each class, with all its columns; rows without words all stay.

    Null and empty texts have no words. Of a class the row that `classes` keeps stays; of rows that
    repeat its id and text, one. A null id is an id like any other. Texts count whole, however
    long. Columns may have any names. No rows give no rows.
    """
    own, names = numbered_columns(docs)
    doc_id, text = names[doc_id], names[text]
    keepers = (classes(own, doc_id, text, similarity).where("kept")
               .select(F.col("doc_id").alias("_dup_id"), F.col("digest").alias("_dup_digest")).distinct())
    keyed = own.withColumn("_dup_own", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_dup_id")) & (F.col("_dup_own") == F.col("_dup_digest"))
    one = Window.partitionBy("_dup_id", "_dup_digest").orderBy(F.lit(1))
    wordless = ~F.coalesce(F.col(text).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False))
    return (keyed.join(keepers, same)
            .withColumn("_dup_n", F.row_number().over(one))
            .where((F.col("_dup_n") == 1) | wordless).select(*[F.col(n).alias(c) for c, n in names.items()]))
