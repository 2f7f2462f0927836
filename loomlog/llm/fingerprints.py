"""One-permutation MinHash fingerprints with densification and packed low-order bits."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words

#: Bins, low-order bits kept of each, and words in a shingle.
BINS, BITS, WIDTH = 256, 4, 5
_VALUE_BITS = 54
_EMPTY = (1 << _VALUE_BITS) - 1
#: Bins that an empty one tries before it looks at all filled ones.
_TRIES = 6


def sketch_steps(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the fingerprint of column ``text`` as BINS hexadecimal digits, '' if it has no word.

    Each word shingle is hashed once; the hash's top bits say its bin, which keeps
    the smallest of the rest.  An empty bin takes over another's minimum: it tries
    bins in an order that depends on its own number only, so equal sets fill
    equally and two sets agree with the likeness of their filled bins.
    """
    w, p, s = f"_{out}_w", f"_{out}_p", f"_{out}_s"
    df = df.withColumn(w, words(F.col(text)))
    size = F.size(w)
    one = F.array(F.xxhash64(F.array_join(w, " ")))
    shingle = lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(WIDTH)])
    hashes = F.when(size == 0, F.array().cast("array<bigint>")).when(size < WIDTH, one).otherwise(F.transform(F.sequence(F.lit(0), size - WIDTH), shingle))
    packed = F.transform(hashes, lambda h: F.shiftrightunsigned(h, 64 - 8 - _VALUE_BITS).bitwiseAND(F.lit((1 << (8 + _VALUE_BITS)) - 1)))
    # with a mark for each bin behind all its values, the first entries of the bins are one a bin, in order
    marks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), _VALUE_BITS).bitwiseOR(F.lit(_EMPTY)))
    df = df.withColumn(p, F.sort_array(F.concat(packed, marks)))
    bin_of = lambda x: F.shiftrightunsigned(x, _VALUE_BITS)
    first = F.filter(p, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(p), i - 1))))
    df = df.withColumn(s, F.transform(first, lambda x: F.nullif(x.bitwiseAND(F.lit(_EMPTY)), F.lit(_EMPTY))))

    def tried(b: Column, k: int) -> Column:
        return F.get(F.col(s), F.pmod(F.xxhash64(b, F.lit(k)), F.lit(BINS)).cast("int"))

    def nearest(b: Column) -> Column:
        """The filled bin with the smallest hash together with this one."""
        filled = F.transform(F.col(s), lambda v, j: F.when(v.isNotNull(), F.struct(F.xxhash64(b, j, F.lit(_TRIES)).alias("h"), v.alias("v"))))
        return F.array_min(filled)["v"]

    dense = F.transform(s, lambda v, b: F.coalesce(v, *[tried(b, k) for k in range(_TRIES)], nearest(b)))
    # hashed with its bin, a minimum that many bins take over does not give all of them the same bits
    digits = F.transform(dense, lambda v, b: F.lower(F.hex(F.xxhash64(v, b).bitwiseAND(F.lit((1 << BITS) - 1)))))
    kept = [c for c in df.columns if c not in (w, p, s)]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.when(F.size(w) == 0, "").otherwise(F.array_join(digits, "")).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two fingerprints, without the share of low-order bits that agree by chance.

    Two empty fingerprints are alike (1), an empty and another are not (0).
    """
    chance = 2.0**-BITS
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) & (x != "")), lambda e: e))
    estimate = F.greatest(F.lit(0.0), (same / F.lit(BINS) - chance) / (1 - chance))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(estimate)


def next_by_id(docs: DataFrame, columns: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df, derived: tuple[str, ...] = ()) -> DataFrame:
    """Add ``next_<column>`` of the next row in descending doc_id; after the last row comes the first.

    ``derive`` adds the columns ``derived`` that follow from ``columns``.  They are
    worked out once for all rows, and once more for the first row of each range only.

    Rows are dealt by ranges of doc_id, a few thousand rows each, and ordered
    inside a range; a range's last row goes on with the first row of the next
    one, which a small table of ranges holds.  Equal ids follow each other in the
    order of their columns; null ids come last.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("double").alias("id"))
    parts = max(4, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(ids.where("id is not null").approxQuantile("id", [i / parts for i in range(1, parts)], 0.25 / parts) or []))
    bucket = F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    if cuts:  # two short searches instead of one long one
        coarse = cuts[::step]
        rows = F.array(*[F.array(*[F.lit(float(x)) for x in cuts[i : i + step]]) for i in range(0, len(cuts), step)])
        at = F.size(F.filter(F.array(*[F.lit(float(x)) for x in coarse]), lambda x: x <= F.col("doc_id").cast("double")))
        inside = F.size(F.filter(F.coalesce(F.get(rows, F.col("_coarse") - 1), F.array().cast("array<double>")), lambda x: x <= F.col("doc_id").cast("double")))
        docs = docs.withColumn("_coarse", F.coalesce(at, F.lit(0)))
        bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(F.greatest(F.col("_coarse") - 1, F.lit(0)) * step + inside)
    docs = docs.withColumn("_range", bucket.cast("int")).drop("_coarse")
    order = [F.col("doc_id").desc_nulls_last(), *[F.col(c) for c in columns]]
    # the first row of a range is its largest id
    first = docs.groupBy("_range").agg(F.min_by(F.struct(*columns), F.struct(-F.col("doc_id"), *columns)).alias("_row"))
    first = derive(first.select("_range", "_row.*"))
    docs = derive(docs)
    columns = [*columns, *derived]
    first = first.select("_range", F.struct(*columns).alias("_head"))
    heads = Window.orderBy(F.col("_range").desc())
    ring = first.select("_range", F.lead("_head").over(heads).alias("_after"), F.first("_head").over(heads.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_start"))
    ring = ring.select("_range", F.coalesce("_after", "_start").alias("_after"))
    own = Window.partitionBy("_range").orderBy(*order)
    rows = docs.select("*", F.lead(F.struct(*columns)).over(own).alias("_own")).join(ring, "_range")
    return rows.select(*[c for c in docs.columns if c != "_range"], *[F.coalesce(F.col("_own")[c], F.col("_after")[c]).alias(f"next_{c}") for c in columns])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    The edited text has the last floor(n/2) code points replaced by the first as
    many (or all) of the next document's.  Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next.  Null texts count
    as empty; other columns than doc_id and text are not read; repeated rows
    follow each other.
    """
    df = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = next_by_id(df, ["text"], lambda rows: sketch_steps(rows, "text", "fingerprint"), ("fingerprint",))
    half = (F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    near = likeness(F.col("fingerprint"), F.col("next_fingerprint"))
    df = df.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", near.alias("near_next"))
    df = df.withColumn("edited_sha256", F.sha2("edited", 256))
    df = sketch_steps(df, "edited", "edited_fingerprint")
    return df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), "near_next")
