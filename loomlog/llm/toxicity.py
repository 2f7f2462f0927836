"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import trimmed

#: Bounds of the sample on which the classifier is fitted: toxic and clean documents, and characters of all.
MAX_TOXIC, MAX_CLEAN, MAX_TRAIN_CHARS = 1_000, 3_000, 40_000_000
BUCKET_BITS, DIMENSIONS = 17, 8
SIZES = (3, 4, 5)
PASSAGE_WORDS = 10
#: Added to the number of subwords of which a passage's average is taken, so that scraps weigh little.
SHRINK = 30


def _clean(text: str) -> np.ndarray:
    """Lower-cased code points with single spaces, one at either end."""
    codes = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes if len(codes) > 2 else codes[:1]


def buckets(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size the hashed bucket at each position, and whether it counts.

    N-grams lie within one word and the spaces at its ends, so misspelled words
    share most of theirs with the usual spelling.
    """
    blank = codes == 32
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            return
        h = np.full(m, n, dtype=np.uint32)
        inner = np.zeros(m, dtype=bool)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = (h ^ codes[k : k + m]) * np.uint32(16777619)
                if 0 < k < n - 1:
                    inner |= blank[k : k + m]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        yield h >> np.uint32(32 - BUCKET_BITS), ~inner


def passages(codes: np.ndarray) -> np.ndarray:
    """Where each passage of PASSAGE_WORDS words begins."""
    spaces = np.flatnonzero(codes == 32)
    return spaces[:-1:PASSAGE_WORDS] if len(spaces) > 1 else np.zeros(1, dtype=np.int64)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each passage of a text, one passage after another, and how many each has."""
    codes = _clean(text)
    starts = passages(codes)
    passage = np.zeros(len(codes), dtype=np.uint32 if len(starts) < 1 << (31 - BUCKET_BITS) else np.uint64)
    passage[starts[1:]] = 1
    passage = np.cumsum(passage, dtype=passage.dtype) << BUCKET_BITS
    parts = [passage[:0]]
    for ids, counts in buckets(codes):
        parts.append((passage[: len(ids)] | ids)[counts])
    found = np.sort(np.concatenate(parts))
    if len(found):
        found = found[np.concatenate(([True], found[1:] != found[:-1]))]
    ends = np.searchsorted(found, (np.arange(1, len(starts) + 1) << BUCKET_BITS).astype(passage.dtype))
    return (found & ((1 << BUCKET_BITS) - 1)).astype(np.uint32), np.diff(ends, prepend=0)


@dataclass
class Model:
    """The embeddings' product with the softmax weights (a figure a bucket), and the calibration."""

    weight: np.ndarray
    bias: float
    slope: float
    level: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """The largest logit of any passage, by text."""
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            ids, sizes = _bag(text)
            ends = np.cumsum(sizes)
            sums = np.concatenate(([0.0], np.cumsum(self.weight[ids], dtype=np.float64)))
            out[i] = ((sums[ends] - sums[ends - sizes]) / (sizes + SHRINK)).max() + self.bias
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.level, -30, 30)))


def train(texts: list[str], labels: list[int], rounds: int = 4, epochs: int = 3, rate: float = 0.3, seed: int = 11) -> Model:
    """Embeddings E and softmax weights W by joint AdaGrad steps on cross-entropy.

    A label belongs to a document, not to its passages.  So after each round a
    toxic document goes on with its passages that look toxic, its worst one at
    least, and clean documents with those that look toxic and a share of the others.
    """
    rng = np.random.default_rng(seed)
    embed = (rng.random((1 << BUCKET_BITS, DIMENSIONS), dtype=np.float32) - 0.5) / DIMENSIONS
    soft = np.zeros((DIMENSIONS, 2), dtype=np.float32)
    soft[:, 1] = rng.random(DIMENSIONS, dtype=np.float32) - 0.5
    bias = np.zeros(2, dtype=np.float32)
    seen_e, seen_w = np.full(len(embed), 1e-6, dtype=np.float32), np.full(soft.shape, 1e-6, dtype=np.float32)
    bags = [_bag(t) for t in texts]
    owner = np.repeat(np.arange(len(bags)), [len(n) for _, n in bags])
    flat = np.concatenate([np.empty(0, np.uint32), *(ids for ids, _ in bags)])
    sizes = np.concatenate([np.empty(0, np.int64), *(n for _, n in bags)])
    begins = np.cumsum(sizes) - sizes
    del bags
    toxic = np.array(labels, dtype=np.int64)[owner] if len(owner) else np.empty(0, np.int64)
    full = np.flatnonzero(sizes > 0)
    if not len(full) or len(set(labels)) < 2:
        base = float(np.clip(np.mean(labels), 0.02, 0.98)) if labels else 0.02
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 0.0, 1.0, float(np.log(base / (1 - base))))

    def forward(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.cumsum(sizes[some]) - sizes[some]
        ids = flat[np.repeat(begins[some] - own, sizes[some]) + np.arange(sizes[some].sum())]
        hidden = np.add.reduceat(embed[ids], own) / (sizes[some][:, None] + SHRINK)
        z = hidden @ soft + bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return ids, hidden, z / z.sum(axis=1, keepdims=True)

    rows = full[(toxic[full] == 1) | (rng.random(len(full)) < 0.3)]
    for turn in range(rounds):
        weigh = len(rows) / (2.0 * np.maximum(np.bincount(toxic[rows], minlength=2), 1))
        for _ in range(epochs):
            rng.shuffle(rows)
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                ids, hidden, p = forward(some)
                p[np.arange(len(some)), toxic[some]] -= 1
                p *= (weigh[toxic[some]] / len(some))[:, None]
                back = (p @ soft.T) / (sizes[some][:, None] + SHRINK)
                uniq, inverse = np.unique(ids, return_inverse=True)
                each = np.repeat(np.arange(len(some)), sizes[some])
                grad = np.stack([np.bincount(inverse, back[each, k], minlength=len(uniq)) for k in range(DIMENSIONS)], axis=1)
                grad_w = hidden.T @ p
                seen_e[uniq] += (grad**2).mean(axis=1)
                embed[uniq] -= rate * grad / np.sqrt(seen_e[uniq])[:, None]
                seen_w += grad_w**2
                soft -= rate * grad_w / np.sqrt(seen_w)
                bias -= rate * p.sum(axis=0)
        if turn < rounds - 1:
            probability = np.zeros(len(sizes))
            for at in range(0, len(full), 512):
                probability[full[at : at + 512]] = forward(full[at : at + 512])[2][:, 1]
            worst = np.zeros(len(texts))
            np.maximum.at(worst, owner, probability)
            stays = np.where(toxic == 1, (probability >= 0.5) | (probability == worst[owner]), (probability > 0.1) | (rng.random(len(sizes)) < 0.2))
            rows = full[stays[full]]
    model = Model((embed @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), 1.0, 0.0)
    x, y = model.logits(texts), np.array(labels, dtype=np.float64)
    middle, spread = float(np.median(x)), float(x.std() + 1e-9)
    z, a, b = (x - middle) / spread, 1.0, 0.0
    for _ in range(400):  # a logistic fit of the label on the worst passage; a toxic document counts twice
        p = 1 / (1 + np.exp(-(a * z + b)))
        off = (p - y) * (1 + y)
        a -= 0.5 * ((off * z).mean() + 0.002 * a)
        b -= 0.5 * off.mean()
    model.slope, model.level = a / spread, b - a * middle / spread
    return model


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit on at most ``max_toxic`` and ``max_clean`` documents of the labels, chosen by hash.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic; null labels are
    left out and of repeated ones the largest holds.  Whole texts of any length
    count, in the order of the hash until MAX_TRAIN_CHARS are reached.
    """
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    chosen = known.where("_toxic = 1").orderBy(order).limit(max_toxic).unionByName(known.where("_toxic = 0").orderBy(order).limit(max_clean))
    rows = docs.where("text <> ''").join(F.broadcast(chosen), "doc_id").select("text", "_toxic", "doc_id", order.alias("_order"), F.length("text").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_order", "doc_id", "_n", "text"))  # over the few rows that are chosen
    rows = rows.where(F.col("_n") <= MAX_TRAIN_CHARS).withColumn("_upto", upto).where(F.col("_upto") <= MAX_TRAIN_CHARS).drop("_upto", "_n", "_order")
    found = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in found], [r["_toxic"] for r in found])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from ``threshold`` on) to every row's whole text.

    Null and empty texts have no subwords; they get the score of the bias alone.
    Repeated rows are scored each.  Other columns pass through; those named like
    the new ones are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType(list(docs.schema.fields)).add("score", "double").add("predicted", "integer")
    held = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = held.value.scores([text.as_py() or "" for text in batch.column(where)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.mapInArrow(trimmed(run), schema)
