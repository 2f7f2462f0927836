"""Language ID by interpolated Kneser-Ney character models, one per language."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import durable, trimmed

ORDER = 4
#: Parts of the rows, each measured by a model of the others, to calibrate the rejection; cross-entropies are rounded to 1 / BINS.
FOLDS, BINS = 2, 1024
#: Lengths in characters for which the rejection has limits, and the share of held-out pieces above a limit.
BANDS = [1 << i for i in range(1, 12)]
REJECT = 0.005
#: A language's limit for a length is its own from so many held-out pieces on.
LEAST_PIECES = 20
UNKNOWN = "und"
_CHARS, _PIECES = 1_000_000, 200_000


def fold(text: str) -> np.ndarray:
    """Lower-cased letters as 16-bit codes, each run of anything else as one space, spaces at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter(codes)
    codes = np.where(letter, (codes & 0xFFFF) ^ (codes >> 16), 32).astype(np.uint64)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
    return codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]


_LETTERS = np.zeros(0, dtype=bool)


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _LETTERS
    if not len(_LETTERS):
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS[codes]


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Key of the n-gram that ends at each character from the second on; 16 bits a character.

    Near the start there are fewer than n - 1 characters before; the space at the
    start stands for those.
    """
    padded = np.concatenate((np.full(n, 32, dtype=np.uint64), codes))
    key = np.zeros(len(codes), dtype=np.uint64)
    for k in range(n):
        key = (key << np.uint64(16)) | padded[k + 1 : k + 1 + len(codes)]
    return key[1:]


def _batches(texts: pa.Array, chars: int = _CHARS) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Rows, their joined codes and where each begins, about ``chars`` characters at a time."""
    rows: list[int] = []
    parts: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(texts):
        parts.append(fold(text.as_py() or ""))
        rows.append(i)
        size += len(parts[-1])
        if size >= chars or i == len(texts) - 1:
            lengths = np.array([len(p) for p in parts])
            yield rows, np.concatenate(parts), np.concatenate(([0], np.cumsum(lengths)))
            rows, parts, size = [], [], 0


def _joined_grams(codes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram keys of joined documents (those that would cross a border take spaces before it) and their rows.

    Each document begins with a space.  Characters before that one are spaces too.
    """
    position = np.arange(len(codes))
    own = np.repeat(starts[:-1], np.diff(starts))
    key = np.zeros(len(codes), dtype=np.uint64)
    for k in range(n - 1, -1, -1):
        at = np.maximum(position - k, own)
        key = (key << np.uint64(16)) | codes[at]
    scored = position > own
    return key[scored], np.repeat(np.arange(len(starts) - 1), np.diff(starts))[scored]


def count_grams(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often each n-gram of the highest order is in each language.

    Every whole text of every row with a language counts.  Counts are summed in
    the tasks before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for rows, codes, starts in _batches(batch.column(1)):
                keys, row = _joined_grams(codes, starts, order)
                lang_of = langs[rows]
                for lang in set(lang_of):
                    found = np.unique(keys[(lang_of == lang)[row]], return_counts=True)
                    if lang in total:
                        have = total[lang]
                        merged, back = np.unique(np.concatenate((have[0], found[0])), return_inverse=True)
                        found = (merged, np.bincount(back, np.concatenate((have[1], found[1]))).astype(np.int64))
                    total[lang] = list(found)
        for lang, (keys, n) in total.items():
            for at in range(0, len(keys), 100_000):
                some = keys[at : at + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(n[at : at + 100_000].astype(np.int64))], names=["lang", "gram", "n"])

    rows = labelled.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(trimmed(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted arrays: for each order the whole 64-bit keys of all n-grams seen, and a row of log-probabilities a key.

    They grow with the distinct n-grams of the corpus; none is pruned or merged.

    ``backoff`` has, by order, the sorted keys of contexts and the log of the
    weight that each language gives to the next lower order after them.
    """

    langs: list[str]
    probability: dict[int, tuple[np.ndarray, np.ndarray]]
    backoff: dict[int, tuple[np.ndarray, np.ndarray]]
    unseen: float
    #: By language ("" for any other): log2 of lengths, and the usual cross-entropy and the limit of it at each.
    usual: dict[str, tuple[list[float], list[float], list[float]]] = field(default_factory=dict)

    def surprise(self, lang: str, n: int, entropy: float) -> float:
        """How far the cross-entropy of ``n`` characters lies above the usual, as a share of the way to the limit."""
        at, middle, limit = self.usual.get(lang) or self.usual.get("") or ([], [], [])
        if not at:
            return 0.0
        usual, most = np.interp(math.log2(n), at, middle), np.interp(math.log2(n), at, limit)
        return max(0.0, float((entropy - usual) / (most - usual)))

    def log_likelihood(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-likelihood by document and language, and the characters scored."""
        n_docs = len(starts) - 1
        total = np.zeros((n_docs, len(self.langs)))
        keys, row = _joined_grams(codes, starts, ORDER)
        n = np.bincount(row, minlength=n_docs)
        for order in range(ORDER, 0, -1):
            if not len(keys):
                break
            slots = hash_key(keys, order)
            table, values = self.probability[order]
            at = np.minimum(np.searchsorted(table, slots), max(len(table) - 1, 0))
            seen = table[at] == slots if len(table) else np.zeros(len(slots), dtype=bool)
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(row[seen], values[at[seen], k], minlength=n_docs)
            keys, row = keys[~seen], row[~seen]
            if order > 1 and len(keys):  # back off: the weight of the context, then the shorter n-gram
                context, weights = self.backoff[order]
                slots = hash_key(keys >> np.uint64(16), order - 1)
                at = np.minimum(np.searchsorted(context, slots), max(len(context) - 1, 0))
                there = context[at] == slots if len(context) else np.zeros(len(slots), dtype=bool)
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(row[there], weights[at[there], k], minlength=n_docs)
                keys = keys & np.uint64((1 << (16 * (order - 1))) - 1)
            elif len(keys):
                total += np.bincount(row, minlength=n_docs)[:, None] * self.unseen
        return total, n

    def steps(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-likelihood of each character by language; 0 for the space that a document begins with."""
        out = np.zeros((len(codes), len(self.langs)))
        place = np.ones(len(codes), dtype=bool)
        place[starts[:-1]] = False
        at_, keys = np.flatnonzero(place), _joined_grams(codes, starts, ORDER)[0]
        for order in range(ORDER, 0, -1):
            if not len(keys):
                break
            table, values = self.probability[order]
            at, seen = _looked_up(table, hash_key(keys, order))
            out[at_[seen]] += values[at[seen]]
            keys, at_ = keys[~seen], at_[~seen]
            if order > 1 and len(keys):
                context, weights = self.backoff[order]
                at, there = _looked_up(context, hash_key(keys >> np.uint64(16), order - 1))
                out[at_[there]] += weights[at[there]]
                keys = keys & np.uint64((1 << (16 * (order - 1))) - 1)
            elif len(keys):
                out[at_] += self.unseen
        return out


def _looked_up(table: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each slot is in a sorted table, and whether it is there."""
    at = np.minimum(np.searchsorted(table, slots), max(len(table) - 1, 0))
    return at, table[at] == slots if len(table) else np.zeros(len(slots), dtype=bool)


def hash_key(keys: np.ndarray, order: int) -> np.ndarray:
    """What the tables of an order are sorted and looked up by: all 64 bits, so that no two n-grams share one."""
    return keys.astype(np.uint64, copy=False)


def kneser_ney(counts: DataFrame, order: int = ORDER) -> Model:
    """The model of all n-gram counts (lang, gram, n)."""
    return kneser_neys(counts, [F.lit(True)], order)[0]


def kneser_neys(counts: DataFrame, parts: list[Column], order: int = ORDER) -> list[Model]:
    """Interpolated Kneser-Ney models of the counts that meet each condition of ``parts``, all in the same joins and sums.

    A row is an n-gram with a column a part and language.  Below the highest
    order an n-gram counts once for each character that has come before it.
    Tables hold each n-gram that some language has, with every language's
    probability, so that scoring looks up once; they come to the driver, 8 bytes
    and 8 a language for each distinct n-gram.
    """
    mask = lambda n: F.lit((1 << (16 * n)) - 1).cast("long")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        none = (np.empty(0, np.uint64), np.empty((0, 0)))
        return [Model([], dict.fromkeys(range(1, order + 1), none), dict.fromkeys(range(2, order + 1), none), 0.0) for _ in parts]
    columns = [(j, i) for j in range(len(parts)) for i in range(len(langs))]
    name = lambda what, c: f"{what}{c[0]}_{c[1]}"
    c = {x: F.col(name("c", x)) for x in columns}
    levels = {order: durable(counts.groupBy("gram").agg(*[F.coalesce(F.sum(F.when((F.col("lang") == langs[i]) & parts[j], F.col("n"))), F.lit(0)).alias(name("c", (j, i))) for j, i in columns]))}
    for n in range(order - 1, 0, -1):
        levels[n] = durable(levels[n + 1].groupBy(F.col("gram").bitwiseAND(mask(n)).alias("gram")).agg(*[F.count_if(c[x] > 0).alias(name("c", x)) for x in columns]))
    some = [F.greatest(*[c[j, i] for i in range(len(langs))], F.lit(0)) > 0 for j in range(len(parts))]
    letters = [max(1, x) for x in levels[1].agg(*[F.count_if(x) for x in some]).first()]
    models = [Model(langs, {}, {}, -math.log(x + 1)) for x in letters]
    lower = None
    for n in range(1, order + 1):
        level = levels[n]
        ones = level.agg(*[f for x in columns for f in (F.count_if(c[x] == 1), F.count_if(c[x] == 2))]).first()
        cut = {x: one / (one + 2 * two) if one * two > 0 else 0.5 for x, one, two in zip(columns, ones[::2], ones[1::2])}
        context = F.shiftrightunsigned("gram", 16)
        sums = level.groupBy(context.alias("context")).agg(*[f for x in columns for f in (F.sum(c[x]).alias(name("t", x)), F.count_if(c[x] > 0).alias(name("k", x)))])
        rows = level.withColumn("context", context).join(sums, "context")
        if lower is not None:
            rows = rows.withColumn("rest", F.col("gram").bitwiseAND(mask(n - 1)))
            rows = rows.join(lower.select(F.col("gram").alias("rest"), *[F.col(name("p", x)).alias(name("b", x)) for x in columns]), "rest")
        out = []
        for x in columns:
            total, kinds = F.col(name("t", x)), F.col(name("k", x))
            below = F.lit(1.0 / (letters[x[0]] + 1)) if lower is None else F.col(name("b", x))
            weight = F.when(total > 0, cut[x] * kinds / total).otherwise(1.0)
            own = F.when(total > 0, F.greatest(c[x] - cut[x], F.lit(0.0)) / total).otherwise(0.0)
            out += [(own + weight * below).alias(name("p", x)), weight.alias(name("w", x))]
        lower = durable(rows.select("gram", *out, *[x.alias(f"some{j}") for j, x in enumerate(some)]))
        logs = [F.log(name(w, x)).cast("float") for w in "pw" for x in columns]
        found = lower.select("gram", *logs, *[f"some{j}" for j in range(len(parts))]).toArrow()
        keys = found.column(0).to_numpy().astype(np.int64).view(np.uint64)
        order_ = np.argsort(keys)
        values = [found.column(1 + i).to_numpy()[order_] for i in range(2 * len(columns))]
        for j, model in enumerate(models):
            here = found.column(1 + 2 * len(columns) + j).to_numpy(zero_copy_only=False)[order_]
            own, at = keys[order_][here], j * len(langs)
            model.probability[n] = (own, np.stack([v[here] for v in values[at : at + len(langs)]], axis=1))
            if n > 1:
                contexts, first = np.unique(own >> np.uint64(16), return_index=True)
                at += len(columns)
                model.backoff[n] = (contexts, np.stack([v[here][first] for v in values[at : at + len(langs)]], axis=1))
    return models


OUT = "lang_pred string, score double, cross_entropy double, surprise double"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred, score, cross_entropy (nats a character) and surprise to every row.

    The language with the lowest length-normalised cross-entropy wins.  score is
    its posterior tempered by length, so it is low for short and doubtful texts.
    surprise tells how far the cross-entropy lies above what is usual for the
    language and length: 1 at the held-out limit (0 without calibration).  Null texts and those
    without a letter get UNKNOWN, score 0 and null figures; so does every text
    if no language was learned.  Other columns pass through; those with one of
    these names are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "cross_entropy", "surprise")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    names = {x.name for x in docs.schema.fields}
    schema = StructType(list(docs.schema.fields))
    for name, kind in (x.split() for x in OUT.split(", ")):
        schema = schema.add(name, kind)
    held = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index("text")
    assert "text" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        for batch in batches:
            size = batch.num_rows
            pred = np.full(size, UNKNOWN, dtype=object)
            score, entropy, surprise = np.zeros(size), np.full(size, np.nan), np.full(size, np.nan)
            for rows, codes, starts in _batches(batch.column(where)):
                if not m.langs:
                    break
                total, n = m.log_likelihood(codes, starts)
                for r, (i, k) in enumerate(zip(rows, n.tolist())):
                    if k > 1 or (k == 1 and codes[starts[r + 1] - 1] != 32):
                        mean = total[r] / k
                        best = int(mean.argmax())
                        weights = np.exp((mean - mean[best]) * min(k, 400))
                        pred[i], score[i], entropy[i] = m.langs[best], 1 / weights.sum(), -mean[best]
                        surprise[i] = m.surprise(m.langs[best], k, -mean[best])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(surprise, from_pandas=True)],
                names=[*kept, "lang_pred", "score", "cross_entropy", "surprise"],
            )

    return docs.mapInArrow(trimmed(run), schema)


def _pieces(rows: DataFrame, models: list[Model]) -> DataFrame:
    """(lang, band, entropy, n): how many texts, and pieces of them of each shorter length, have which cross-entropy.

    A row (text, lang, fold) is scored by the model of its fold, ``models[fold]``;
    texts whose language that model does not tell are left out.  Pieces begin at
    the first word and at one in the middle, and end where a word does; a
    piece's band is the length of BANDS next to its own.  Cross-entropies are
    rounded to 1 / BINS, so that rows are few whatever the number of texts.
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def measured(m: Model, codes: np.ndarray, starts: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and length of each piece, and its summed log-likelihood in that language."""
        lengths = np.diff(starts)
        first = starts[:-1] + 1  # behind the space that each text begins with
        spaces = np.flatnonzero(codes == 32)
        middle = spaces[np.searchsorted(spaces, starts[:-1] + lengths // 2)] + 1
        begins, ends, owners = [first], [starts[1:]], [np.arange(len(lengths))]
        for start in (first, middle):
            for band in BANDS:
                some = np.flatnonzero(start + band < starts[1:])
                stop = spaces[np.searchsorted(spaces, start[some] + band)] + 1
                part = (stop < starts[some + 1]) | (start[some] > first[some])  # not the text itself
                begins.append(start[some][part])
                ends.append(stop[part])
                owners.append(some[part])
        begin, end, owner = np.concatenate(begins), np.concatenate(ends), np.concatenate(owners)
        steps = m.steps(codes, starts)
        sums = np.concatenate((np.zeros((1, len(m.langs))), np.cumsum(steps, axis=0)))
        total = sums[end] - sums[begin]
        whole = total[: len(first)].argmax(axis=1)
        told = (np.array(m.langs, dtype=object)[whole] == langs) & (lengths > 2)
        keep = told[owner]
        total, n = total[keep], (end - begin)[keep]
        best = total.argmax(axis=1)
        band = np.clip(np.rint(np.log2(n)).astype(np.int64), 1, len(BANDS))
        bins = np.rint(-total[np.arange(len(best)), best] / n * BINS).astype(np.int64)
        return np.unique((best * (len(BANDS) + 1) + band) << 32 | bins, return_counts=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        found: dict[tuple[int, int], int] = {}
        for batch in batches:
            langs, folds = np.array(batch.column(1).to_pylist(), dtype=object), np.array(batch.column(2).to_pylist())
            for fold_ in set(folds.tolist()):
                some = np.flatnonzero(folds == fold_)
                if not have[fold_].langs:
                    continue
                for rows_, codes, starts in _batches(batch.column(0).take(pa.array(some)), _PIECES):
                    for key, n in zip(*(x.tolist() for x in measured(have[fold_], codes, starts, langs[some[rows_]]))):
                        found[fold_, key] = found.get((fold_, key), 0) + n
        names = [have[fold_].langs[(key >> 32) // (len(BANDS) + 1)] for fold_, key in found]
        bands = [1 << ((key >> 32) % (len(BANDS) + 1)) for _, key in found]
        columns = [pa.array(names, pa.string()), pa.array(bands, pa.int32()), pa.array([(key & 0xFFFFFFFF) / BINS for _, key in found], pa.float64()), pa.array(list(found.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "band", "entropy", "n"])

    return rows.select("text", "lang", "fold").mapInArrow(trimmed(run), "lang string, band int, entropy double, n long")


def _limits(pieces: DataFrame) -> dict[str, tuple[list[float], list[float], list[float]]]:
    """Usual cross-entropy and limit by language and band, and for "" of all languages together.

    The limit is the held-out quantile at 1 - REJECT, farther from the usual
    figure by 3 / sqrt(n) of the way where ``n`` pieces make that uncertain.
    """
    figures = [F.sum("n"), F.percentile("entropy", 0.5, F.col("n")), F.percentile("entropy", 1 - REJECT, F.col("n"))]
    counts = pieces.groupBy("lang", "band", "entropy").agg(F.sum("n").alias("n"))
    rows = counts.withColumn("lang", F.explode(F.array(F.col("lang"), F.lit("")))).groupBy("lang", "band").agg(*figures).collect()
    out: dict[str, tuple[list[float], list[float], list[float]]] = {}
    for lang, band, n, middle, high in sorted(tuple(r) for r in rows):
        if n >= LEAST_PIECES:
            at, usual, limit = out.setdefault(lang, ([], [], []))
            at.append(math.log2(band))
            usual.append(middle)
            limit.append(middle + max((high - middle) * (1 + 3 / math.sqrt(n)), 0.1))
    return out


def fit(labelled: DataFrame, calibrate: bool = True) -> Model:
    """Learn from ``text`` and non-null ``lang`` of all rows.

    The n-gram counts cover every row, and so does what is measured: which
    cross-entropy is usual for each language and length, and which is too much.
    Rows are dealt into FOLDS by their text, so that copies are in one, and each
    is measured by a model that is learned from the others.
    """
    rows = labelled.where(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    if not calibrate or rows.isEmpty():
        return kneser_ney(count_grams(labelled))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    counts = durable(count_grams(rows.select(F.concat(F.col("fold").cast("string"), "lang").alias("lang"), "text")))
    counts = counts.select(F.substring("lang", 2, 1 << 30).alias("lang"), F.substring("lang", 1, 1).cast("int").alias("_fold"), "gram", "n")
    model, *others = kneser_neys(counts, [F.lit(True), *[F.col("_fold") != k for k in range(FOLDS)]])
    model.usual = _limits(_pieces(rows, others))
    return model


def rejected(limit: float = 1.0):
    """What the calibrated rejection turns away: no letter, or a cross-entropy above the limit of its language and length."""
    return (F.col("lang_pred") == UNKNOWN) | (F.col("surprise") > limit)
