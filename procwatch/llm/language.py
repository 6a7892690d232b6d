"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its byte n-grams, hashed into buckets, taken
over the whole text; a linear layer and a softmax follow. Both are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows
(`SAMPLE_PER_LANGUAGE` rows of each language, `SAMPLE_CHARS` characters of each row and fewer
where `SAMPLE_TOTAL` is shared by many languages). Every label is learned. Because averaging and the layer are linear, the trained
model is one table of bucket by language, and a text's logits are the mean of the rows of
its n-grams.

A temperature, fitted on rows of the sample that the training left out, makes the scores
probabilities; the threshold of rejection is the score that all but `REJECTED` of those
rows reach, half at most.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from procwatch.llm.inputs import free_name
from procwatch.llm.words import IS_WORD, LOWER, row_groups, text_buffer
from procwatch.session import materialize

SAMPLE_PER_LANGUAGE = 500
SAMPLE_CHARS = 20_000
SAMPLE_TOTAL = 400_000_000  # characters of the whole sample at most
_DEAL = 64         # parts in which a language's sample is first looked for
REJECTED = 0.001
UNKNOWN = "und"
BUCKETS, DIMENSIONS, GRAMS = 1 << 15, 16, (2, 3, 4)
EPOCHS, RATE, PIECE_BYTES, PIECES = 3, 0.5, (24, 600), 2
_PRIME = np.uint32(0x01000193)


@dataclass
class Model:
    """Logits by bucket and language, their offset, the temperature, the threshold."""

    languages: list[str]
    table: np.ndarray
    offset: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


def gram_buckets(data: np.ndarray) -> list[np.ndarray]:
    """For each n, the bucket of the n-gram that starts at each byte (the last n - 1 have none)."""
    low = LOWER[data]
    latin = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E)) + 1
    low[latin] |= 0x20
    low[~IS_WORD[low]] = 32
    wide = low.astype(np.uint32)
    h = np.full(len(data), 0x811C9DC5, np.uint32)
    out = []
    for n in range(max(GRAMS)):
        m = len(data) - n
        if m <= 0:
            break
        h = (h[:m] ^ wide[n:]) * _PRIME
        if n + 1 in GRAMS:
            x = h ^ (h >> np.uint32(15)) ^ np.uint32(n + 1)
            out.append(((x * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.int64))
    return out


def _features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    found = gram_buckets(data)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, (counts[at] / counts.sum()).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Logits of each text; a text too short for an n-gram gets the offset alone."""
    n = len(offsets) - 1
    sums, counts = np.zeros((n, len(model.languages))), np.zeros(n)
    for start, end in row_groups(offsets, 1 << 18):
        low, high = int(offsets[start]), int(offsets[end])
        for at in range(low, high, 1 << 20):  # more than once only for one long text
            stop = min(high, at + (1 << 20) + max(GRAMS) - 1)
            piece = data[at:stop]
            inner = offsets[start:end + 1] - at
            for gram, buckets in zip(GRAMS, gram_buckets(piece)):
                # n-grams of a text: those that start in it and end in it, each in one piece only
                begins = np.clip(inner[:-1], 0, len(buckets))
                ends = np.clip(np.minimum(inner[1:] - gram + 1, 1 << 20), 0, len(buckets))
                sizes = np.maximum(ends - begins, 0)
                for k in range(len(model.languages)):
                    total = np.concatenate([[0.0], np.cumsum(model.table[:, k][buckets], dtype=np.float64)])
                    sums[start:end, k] += np.where(sizes > 0, total[ends] - total[begins], 0)
                counts[start:end] += sizes
    return sums / np.maximum(counts, 1)[:, None] + model.offset


def train(texts: list[str], labels: list[str], seed: int = 11) -> Model | None:
    """Fit on texts and their languages; without any there is no model."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    y = np.array([languages.index(x) for x in labels])
    # every fifth row of each language is left out for the calibration, if it has that many
    rank = np.zeros(len(y), int)
    for k in range(len(languages)):
        rank[y == k] = np.arange((y == k).sum())
    out = rank % 5 == 4
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, len(languages)), np.float32)
    weights[:] = rng.normal(0, 0.1, weights.shape)
    offset = np.zeros(len(languages), np.float32)
    examples = []
    for i in np.flatnonzero(~out):
        for _ in range(PIECES):
            size = int(rng.integers(*PIECE_BYTES))
            at = int(rng.integers(0, max(1, len(data[i]) - size)))
            examples.append((*_features(data[i][at:at + size]), y[i]))
    for epoch in range(EPOCHS):
        for j, e in enumerate(rng.permutation(len(examples))):
            at, share, label = examples[e]
            if not len(at):
                continue
            rate = RATE * (1 - (epoch * len(examples) + j) / (EPOCHS * len(examples)))
            hidden = share @ embeddings[at]
            error = _softmax(hidden @ weights + offset)
            error[label] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            offset -= rate * 0.1 * error
            # a bucket's step follows its share; scaled so that rare n-grams still move
            embeddings[at] -= (rate * 20) * share[:, None] * back
    model = Model(languages, (embeddings @ weights).astype(np.float32), offset.astype(np.float64))
    return _calibrated(model, [data[i] for i in np.flatnonzero(out)], y[out])


def _calibrated(model: Model, data: list[np.ndarray], y: np.ndarray) -> Model:
    if len(y):
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        x = logits(model, np.concatenate(data), offsets)
        scales = np.geomspace(0.05, 5, 40)
        losses = [-np.log(_softmax(x / t)[np.arange(len(y)), y] + 1e-12).mean() for t in scales]
        model.temperature = float(scales[int(np.argmin(losses))])
        best = _softmax(x / model.temperature).max(1)
        model.threshold = float(min(0.5, np.quantile(best, REJECTED)))
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Train on a bounded sample of the rows that have a language and are not held out.

    Of every language the sample takes the rows whose ids have the smallest hashes; they are
    found without their texts, in parts first, so that a frequent language does not meet in one
    task. A row gives SAMPLE_CHARS characters, or its share of SAMPLE_TOTAL if that is less, which
    begins beyond 40 languages; so the driver holds SAMPLE_TOTAL characters at most.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull()
                        & ~is_held_out(F.col(doc_id)) & F.col(text).rlike(r"\p{L}"))
    hashed = usable.select(F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id)).alias("h"), F.col(text).alias("text"))
    narrow = hashed.select("lang", "h")
    smallest = narrow
    for part in (["lang", F.pmod("h", F.lit(_DEAL))], ["lang"]):
        order = Window.partitionBy(*part).orderBy("h")
        smallest = smallest.withColumn("n", F.row_number().over(order)).where(
            F.col("n") <= SAMPLE_PER_LANGUAGE).drop("n")
    cuts = materialize(smallest.groupBy("lang").agg(F.max("h").alias("cut")), "language-cuts")
    n_languages = cuts.count()
    if not n_languages:
        return None
    n_chars = max(1, min(SAMPLE_CHARS, SAMPLE_TOTAL // (SAMPLE_PER_LANGUAGE * n_languages)))
    rows = (hashed.join(cuts, "lang").where(F.col("h") <= F.col("cut"))
            .groupBy("lang", "h").agg(F.min(F.substring("text", 1, n_chars)).alias("text"))
            .orderBy("lang", "h").collect())  # a repeated id counts once
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add `lang_pred`, `score` and `rejected` to every row; columns of these names are replaced.

    `und`, score 0 and rejected: null texts and texts without a letter, whatever their length.
    Without a model (no labelled rows) all texts are `und` with score 0, and only those without
    a letter are rejected. Whole texts count; equal texts get equal results; ties go to the
    language that comes first. No rows give no rows.
    """
    added = ["lang_pred", "score", "rejected"]
    has_letter = free_name(docs, "_has_letter")
    rows = docs.drop(*added).withColumn(
        has_letter, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    kept = [f for f in rows.schema.fields if f.name != has_letter]
    if model is None:
        return rows.select(*[f.name for f in kept], F.lit(UNKNOWN).alias("lang_pred"),
                           F.lit(0.0).alias("score"), (~F.col(has_letter)).alias("rejected"))
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()),
                           T.StructField("rejected", T.BooleanType())])
    names, position = [f.name for f in kept], rows.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = np.array(model.languages, object)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                p = _softmax(logits(model, *text_buffer(batch.column(position))) / model.temperature)
                letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                best = p.max(1)
                found = np.where(letter, languages[p.argmax(1)], UNKNOWN)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(found, pa.string()),
                     pa.array(np.where(letter, best, 0.0)),
                     pa.array(~letter | (best < model.threshold))],
                    names=[*names, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(judge, schema)
