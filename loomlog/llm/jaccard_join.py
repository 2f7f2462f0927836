"""Exact Jaccard join of word shingles as a metric-space join.

Equal sets are one point.  A point's candidates share one of its rarest
shingles.  Regions are the points around a pivot: a shingle's region has the
point with the smallest share of shingles of its own as its pivot.  Regions that
links to pivots don't connect go on: larger ones are split into Voronoi regions
of more pivots, boundary points go into each region that the triangle inequality
allows, and this is repeated until a region is small and compared point by point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, mix, settle, shingle_hashes, trimmed, word_hashes
from .components import connected_components

#: Two documents link from this similarity on, in hundredths, of shingles of so many words.
PERCENT, WIDTH = 75, 5
#: Shingles of a bucket, about, when their frequencies are counted, and of a batch of documents.
BUCKET_SHINGLES, BATCH_SHINGLES = 2_000_000, 1_500_000
#: Shingles of a region that is compared point by point, and of the pivots that are sent to the tasks in one round.
LEAF_SHINGLES, PIVOT_SHINGLES = 2_000_000, 4_000_000
#: Pivots of a region, at most.
PIVOTS = 32
#: Rows of two numbers that are broadcast at most; more are joined by shuffle.
MAX_BROADCAST = 1_000_000
#: Members of a shingle that meet its pivot in one task, about, and pairs of a region that are compared without a split.
SALT_ROWS, PAIRS = 10_000, 100_000


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text, fold=True), WIDTH))


def set_key(own: np.ndarray) -> int:
    """64 bits that stand for a set, whatever the order."""
    with np.errstate(over="ignore"):
        parts = [mix(own ^ np.uint64(salt)).sum(dtype=np.uint64) for salt in (0x51ED, 0xA11CE)]
        return int(mix(np.array([parts[0] ^ mix(np.array([parts[1] + np.uint64(len(own))]))[0]]))[0].astype(np.int64))


def least_overlap(n, percent: int = PERCENT):
    """Shared shingles that a set of n needs at least to link with any."""
    return -(-percent * n // 100)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, size and key of the shingle set of each whole text; rows that repeat a doc_id have one each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in own], pa.int64()), pa.array([set_key(s) for s in own], pa.int64())], names=["doc_id", "n", "key"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), "doc_id long, n long, key long")


_DEALT = "bucket int, batch long, high binary, low binary, counts binary, keys binary, sizes binary, owners binary, cuts binary"


def _dealt(docs: DataFrame, n_buckets: int) -> DataFrame:
    """The distinct shingles of batches of documents, dealt by bucket of their hash, and one row a batch with their owners.

    Whatever number of documents of a batch has a shingle, its bucket gets it
    once, with that number; of equal sets in a batch only one counts.  The bucket
    and 40 more bits tell shingles apart.
    """
    names = [x.split()[0] for x in _DEALT.split(", ")]
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 7

    def flush(held: dict[int, np.ndarray], batch: int) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in held.values()], dtype=np.int32)
        flat = np.concatenate(list(held.values()))
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        bucket = (mix(flat) % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((flat, bucket))
        flat, bucket, owner = flat[order], bucket[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        counts = np.diff(np.append(first, len(flat))).astype(np.uint32)
        low, bucket = flat[first] & np.uint64((1 << 40) - 1), bucket[first]
        cuts = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=n_buckets)))).astype(np.int32)
        out: list[list] = [[] for _ in range(9)]
        keys = np.array(list(held), dtype=np.int64)
        if len(sizes) <= 1 << 16:
            owner = owner.astype(np.uint16)
        rows = [(-1, batch, None, None, counts.tobytes(), keys.tobytes(), sizes.tobytes(), owner.tobytes(), cuts.tobytes())]
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            some = low[cuts[b] : cuts[b + 1]]
            rows.append((b, batch, (some >> np.uint64(32)).astype(np.uint8).tobytes(), some.astype(np.uint32).tobytes(), counts[cuts[b] : cuts[b + 1]].tobytes(), None, None, None, None))
        for row in rows:
            for column, value in zip(out, row):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # the same when a task runs again
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            for text in batch.column(0):
                own = shingle_set(text.as_py())
                key = set_key(own)
                if len(own) and key not in held:
                    held[key] = own
                    size += len(own)
                if size >= BATCH_SHINGLES:
                    yield flush(held, number)
                    held, size, number = {}, 0, number + 1
        if held:
            yield flush(held, number)

    return docs.select(F.col("text").cast("string")).mapInArrow(trimmed(run), _DEALT)


_read = lambda column, kind: np.concatenate([np.empty(0, kind), *(np.frombuffer(x, dtype=kind) for x in column)])


def _frequencies(rows: pd.DataFrame) -> pd.DataFrame:
    """How often each shingle of a bucket occurs, and its number if that is more than once, for each batch that sent it."""
    flat = (_read(rows["high"], np.uint8).astype(np.uint64) << np.uint64(32)) | _read(rows["low"], np.uint32)
    counts = _read(rows["counts"], np.uint32)
    _, number = np.unique(flat, return_inverse=True)
    often = np.bincount(number, counts).astype(np.uint32)[number]
    ends = np.cumsum([len(x) // 4 for x in rows["low"]])
    out = []
    for batch, bucket, begin, end in zip(rows["batch"], rows["bucket"], np.concatenate(([0], ends[:-1])), ends):
        own = often[begin:end]
        common = own > 1
        out.append((batch, bucket, np.packbits(common).tobytes(), own[common].tobytes(), number[begin:end][common].astype(np.uint32).tobytes()))
    return pd.DataFrame(out, columns=["batch", "bucket", "common", "often", "numbers"])


def shared(docs: DataFrame, n_buckets: int, percent: int = PERCENT) -> DataFrame:
    """(key, n, alone, shingles) of the sets that share enough shingles with others to link at all.

    ``alone`` counts the shingles that no other set has, ``shingles`` are the
    others' numbers, the rarest first.  A link needs least_overlap(n) of them, so
    sets with fewer go.
    """

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["bucket"] < 0].iloc[0]
        keys, sizes = np.frombuffer(own["keys"], np.int64), np.frombuffer(own["sizes"], np.int32).astype(np.int64)
        counts, cuts = np.frombuffer(own["counts"], np.uint32).astype(np.int64), np.frombuffer(own["cuts"], np.int32)
        owner = np.frombuffer(own["owners"], np.uint16 if len(keys) <= 1 << 16 else np.uint32).astype(np.int64)
        often, token = np.ones(len(counts), np.int64), np.zeros(len(counts), np.int64)
        for bucket, c, o, n in zip(rows["bucket"], rows["common"], rows["often"], rows["numbers"]):
            if bucket >= 0:
                begin, end = cuts[bucket], cuts[bucket + 1]
                at = begin + np.flatnonzero(np.unpackbits(np.frombuffer(c, np.uint8), count=end - begin))
                often[at] = np.frombuffer(o, np.uint32)
                token[at] = np.frombuffer(n, np.uint32).astype(np.int64) | (int(bucket) << 32)
        often, token = np.repeat(often, counts), np.repeat(token, counts)
        common = np.bincount(owner[often > 1], minlength=len(keys))
        keep = (often > 1) & (common >= least_overlap(sizes, percent))[owner]
        often, token, owner = often[keep], token[keep], owner[keep]
        order = np.lexsort((token, often, owner))
        often, token, owner = often[order], token[order], owner[order]
        at = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(keys)))))
        some = np.flatnonzero(np.diff(at))
        # a set in several batches has no shingle to itself; the rarest of its shingles may come from its own copies only
        low = np.where(common[some] < sizes[some], 1, often[at[some]])
        rarest = np.bincount(owner[often == np.repeat(often[at[some]], np.diff(at)[some])], minlength=len(keys))[some]
        return pd.DataFrame({"key": keys[some], "n": sizes[some], "alone": (sizes - common)[some], "shingles": [token[at[i] : at[i + 1]].tobytes() for i in some], "low": low, "rarest": rarest})

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            drop = np.where(rows["low"] == rows["m"], rows["rarest"], 0)
            out = pd.DataFrame({"key": rows["key"], "n": rows["n"], "alone": drop, "shingles": [x[8 * k :] for x, k in zip(rows["shingles"], drop)]})
            yield out[rows["n"].to_numpy() - drop >= least_overlap(rows["n"].to_numpy(), percent)]

    dealt = _dealt(docs, n_buckets)
    answers = dealt.where("bucket >= 0").select("bucket", "batch", "high", "low", "counts").groupBy("bucket").applyInPandas(_frequencies, "batch long, bucket int, common binary, often binary, numbers binary")
    batches = dealt.where("bucket < 0").select("batch", "bucket", "counts", "keys", "sizes", "owners", "cuts")
    found = batches.unionByName(answers, allowMissingColumns=True).groupBy("batch").applyInPandas(gather, "key long, n long, alone long, shingles binary, low long, rarest long")
    # equal sets of several batches are one; a shingle that only they have is their own
    names = ("n", "shingles", "low", "rarest")
    once = found.where("low > 1").groupBy("key").agg(F.count("*").alias("m"), *[F.first(c).alias(c) for c in names])
    columns = ("key", "n", "alone", "shingles")
    return found.where("low = 1").select(*columns).unionByName(once.mapInPandas(trimmed(trim), "key long, n long, alone long, shingles binary"))


def _prefixes(found: DataFrame, percent: int) -> DataFrame:
    """(shingle, key, share, most) for the rarest shingles of each set, of which linked sets have one in common.

    All sets order shingles alike, those of one set alone first.  Two that link
    share one of the first n - least_overlap(n) + 1 of both; where the shingle is
    the first that they share, ``most`` says how many they can share at most.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            n, alone = rows["n"].to_numpy(), rows["alone"].to_numpy()
            take = n - least_overlap(n, percent) + 1 - alone
            parts = [np.frombuffer(x, dtype=np.int64)[: max(0, k)] for x, k in zip(rows["shingles"], take)]
            sizes = [len(p) for p in parts]
            place = np.concatenate([np.empty(0, np.int64), *(np.arange(k) for k in sizes)])
            again = lambda x: np.repeat(x, sizes)
            yield pd.DataFrame({"shingle": np.concatenate([np.empty(0, np.int64), *parts]), "key": again(rows["key"].to_numpy()), "share": again(alone / n), "most": again(n - alone) - place})

    return found.select("key", "n", "alone", "shingles").mapInPandas(trimmed(run), "shingle long, key long, share double, most long")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Shared members of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _linked(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) of keys that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, held = [], (None, None)
            for n_a, n_b, s_a, s_b in zip(*[c.to_pylist() for c in batch.columns[2:]]):
                if s_b != held[0]:
                    held = (s_b, np.sort(np.frombuffer(s_b, dtype=np.int64)))
                both = _overlap(np.sort(np.frombuffer(s_a, dtype=np.int64)), held[1])
                keep.append(both * 100 >= (n_a + n_b - both) * percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # both sides are the same rows dealt by key, without a new name, so that Spark deals them once
    sides = found.select("key", "n", "shingles")
    rows = pairs.join(sides.alias("own"), F.col("a") == F.col("own.key")).select("a", "b", F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    rows = rows.join(sides.alias("other"), F.col("b") == F.col("other.key")).select("a", "b", "n_a", F.col("n").alias("n_b"), "s_a", F.col("shingles").alias("s_b"))
    return rows.mapInArrow(trimmed(run), "a long, b long")


def _can_link(n_a, most_a, n_b, most_b, percent: int):
    """Whether sets of these sizes can share enough, where they share at most so many each.

    At a similarity of p hundredths the common shingles are p / (100 + p) of both sizes or more.
    """
    least = F.least if not isinstance(n_a, np.ndarray) else np.minimum
    return least(most_a, most_b) * (100 + percent) >= (n_a + n_b) * percent


def _compare(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of a small region that connect its parts as far as they are linked."""
    rows = rows.drop_duplicates("key").sort_values(["n", "key"], kind="stable")
    keys, n, alone = (rows[c].to_numpy() for c in ("key", "n", "alone"))
    part = {p: p for p in rows["part"]}

    def top(p: int) -> int:
        while part[p] != p:
            part[p] = part[part[p]]
            p = part[p]
        return p

    own = rows["part"].tolist()
    held = [np.sort(np.frombuffer(x, dtype=np.int64)) for x in rows["shingles"]]
    least = np.searchsorted(n, least_overlap(n, percent))  # a set with fewer shingles is too small
    out = []
    for i in range(len(keys)):
        fits = least[i] + np.flatnonzero(_can_link(n[least[i] : i], (n - alone)[least[i] : i], n[i], n[i] - alone[i], percent))
        for j in fits.tolist():
            a, b = top(own[i]), top(own[j])
            if a != b:
                both = _overlap(held[i], held[j])
                if both * 100 >= (n[i] + n[j] - both) * percent:
                    part[a] = b
                    out.append((keys[i], keys[j]))
    return pd.DataFrame(out, columns=["a", "b"])


_REGION = "region long, key long, part long, n long, alone long, shingles binary"


def _split(members: DataFrame, big: DataFrame, percent: int) -> DataFrame:
    """The members of ``big`` regions by Voronoi region of pivots, with guests from across the borders.

    A point's home is its nearest pivot.  A point y that links with x has a
    distance of at most r to it, so d(y, home of x) <= d(x, its home) + r <= d(x,
    home of y) + r <= d(y, home of y) + 2 r: each point is a guest at all pivots
    within that window, and every link meets at home of one of its ends.
    """
    wide = 2 * (100 - percent) / 100 + 1e-9
    chosen: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    share = F.least(F.lit(1.0), F.col("pivots") / F.col("size")) * (1 << 30)
    picked = members.join(F.broadcast(big), "region").where(F.pmod(F.xxhash64("key", "region"), F.lit(1 << 30)) <= share)
    for r in picked.select("region", "key", "n", "shingles").orderBy("region", "key").toLocalIterator():
        chosen.setdefault(r[0], []).append((r[1], r[2], np.sort(np.frombuffer(bytes(r[3]), dtype=np.int64))))
    held = members.sparkSession.sparkContext.broadcast(chosen)

    def below(region: int, pivot: int) -> int:
        """The number of a pivot's region in a region."""
        parts = mix(np.array([region, pivot], np.int64).view(np.uint64))
        return int(mix(parts[:1] ^ (parts[1:] >> np.uint64(1)))[0].astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, to = [], []
            for i, (region, n, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(5).to_pylist())):
                pivots = held.value.get(region)
                if not pivots:
                    rows.append(i)
                    to.append(region)
                    continue
                own = np.sort(np.frombuffer(raw, dtype=np.int64))
                both = np.array([_overlap(own, p[2]) for p in pivots])
                far = 1 - both / (n + np.array([p[1] for p in pivots]) - both)
                for k in np.flatnonzero(far <= far.min() + wide).tolist():
                    rows.append(i)
                    to.append(below(region, pivots[k][0]))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), *batch.take(pa.array(rows, pa.int64())).columns[1:]], names=batch.schema.names)

    return members.join(F.broadcast(big.select("region")), "region", "left_semi").select(*[x.split()[0] for x in _REGION.split(", ")]).mapInArrow(trimmed(run), _REGION)


def _tiles(members: DataFrame, big: DataFrame) -> DataFrame:
    """Regions that pivots do not take apart: each pair of their parts as a small region."""
    rows = members.join(F.broadcast(big), "region")
    part = F.pmod(F.xxhash64("key", "region"), F.col("parts")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts").cast("int") - 1), lambda k: F.xxhash64("region", F.least(part, k), F.greatest(part, k))))
    return rows.select(pair.alias("region"), "key", "part", "n", "alone", "shingles")


def _recurse(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) in regions of members, split again and again until they are small."""
    spark = members.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    while True:
        settle(spark)
        sizes = durable(members.groupBy("region").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")))
        small = F.col("shingles") <= LEAF_SHINGLES
        leaves = members.join(sizes.where(small | (F.col("size") <= 2)).select("region"), "region", "left_semi")
        compared = leaves.groupBy("region").applyInPandas(lambda rows: _compare(rows, percent), "a long, b long")
        links = links.unionByName(durable(compared))
        # the largest regions whose pivots fit are split now, the others in a later round
        largest = sizes.where(~small & (F.col("size") > 2)).orderBy(F.desc("shingles"), "region").limit(1000).collect()
        if not largest:
            return links
        rows, room = [], PIVOT_SHINGLES
        for region, size, shingles in largest:
            pivots = min(PIVOTS, 1 + 2 * shingles // LEAF_SHINGLES, size)
            if not rows or pivots * shingles // size <= room:
                rows.append((region, size, pivots, 1 + 2 * shingles // LEAF_SHINGLES))
                room -= pivots * shingles // size
        now = spark.createDataFrame(rows, "region long, size long, pivots long, parts long")
        rest = members.join(sizes.where(~small & (F.col("size") > 2)).select("region"), "region", "left_semi").join(F.broadcast(now.select("region")), "region", "left_anti")
        total = sum(r[1] for r in rows)
        before = members.join(F.broadcast(now), "region", "left_semi")
        made = durable(_split(before, now, percent))
        shape = made.groupBy("region").count().agg(F.sum("count"), F.max("count")).first()
        if shape[0] > 4 * total or shape[1] > 0.8 * max(r[1] for r in rows):  # no pivots take these apart
            made = durable(_tiles(before, now))
        members = durable(rest.unionByName(made))


def _small(df: DataFrame) -> DataFrame:
    """Marked for a broadcast if it has few rows of few numbers; a common key of the other side is then in no one task."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def links(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between keys that connect all that are linked.

    Each set is a member of the regions of its rare shingles' pivots, and first
    compared with these pivots.  A region whose members these links connect is
    done.  In the others, what is not of the largest connected part meets all
    members that it can link with, by pairs where these are few; where they are
    many the region is joined recursively.
    """
    facts = found.select("key", "n", (F.col("n") - F.col("alone")).alias("shared"))
    pivots = _prefixes(found, percent).groupBy("shingle").agg(F.min(F.struct("share", "key"))["key"].alias("pivot"), F.count("*").alias("size")).where("size > 1")
    pivots = durable(pivots.select("shingle", "pivot", F.ceil(F.col("size") / SALT_ROWS).cast("int").alias("salts")))
    # the members of a common shingle meet its pivot in several tasks
    common = pivots.where("salts > 1").select("shingle", "salts")
    dealt = _prefixes(found, percent).drop("share").join(_small(common), "shingle", "left")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("key"), F.coalesce("salts", F.lit(1)))).drop("salts")
    salted = pivots.select("shingle", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"))
    members = durable(dealt.join(salted, ["shingle", "salt"]).groupBy("pivot", "key").agg(F.max("most").alias("most")).join(facts.select("key", "n"), "key"))
    leaders = durable(facts.withColumnsRenamed({"key": "pivot", "n": "n_b"}).join(pivots.select("pivot").distinct(), "pivot", "left_semi"))
    pairs = members.where("key <> pivot").join(_small(leaders), "pivot")
    pairs = pairs.where(_can_link(F.col("n"), F.col("most"), F.col("n_b"), F.col("shared"), percent)).select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    known = durable(_linked(pairs, found, percent))
    parts = connected_components(known)
    placed = members.join(_small(parts), members["key"] == parts["node"], "left").withColumn("part", F.coalesce("component", "key")).drop("node", "component")
    sizes = placed.groupBy("pivot", "part").agg(F.count("*").alias("k")).groupBy("pivot").agg(F.max_by("part", F.struct("k", "part")).alias("main"), F.max("k").alias("k"), F.sum("k").alias("size")).where("k < size")
    sizes = durable(sizes.select("pivot", "main", ((F.col("size") - F.col("k")) * F.col("size")).alias("work")))
    open_ = durable(placed.join(_small(sizes), "pivot"))
    own = open_.where((F.col("work") <= PAIRS) & (F.col("part") != F.col("main")) & (F.col("key") != F.col("pivot")))
    other = open_.where((F.col("work") <= PAIRS) & (F.col("key") != F.col("pivot")))
    own, other = (x.select("pivot", *[F.col(c).alias(f"{c}_{e}") for c in ("key", "part", "n", "most")]) for x, e in ((own, "a"), (other, "b")))
    meet = other.join(_small(own), "pivot").where("part_a <> part_b").where(_can_link(F.col("n_a"), F.col("most_a"), F.col("n_b"), F.col("most_b"), percent))
    meet = meet.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()
    more = durable(_linked(meet, found, percent))
    many = open_.where(F.col("work") > PAIRS).select(F.col("pivot").alias("region"), "key", "part")
    links_ = known.unionByName(more)
    if many.limit(1).count():
        members = durable(many.join(found, "key").select(*[x.split()[0] for x in _REGION.split(", ")]))
        links_ = links_.unionByName(_recurse(members, percent))
    return links_


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest linked doc_id) of every row.

    A set has the distinct shingles of five words of the lower-cased (A-Z) whole
    text, or the whole sequence if it is shorter.  Null and blank texts have an
    empty set and are linked with nothing.  Equal sets are linked.  Rows that
    repeat a doc_id get a row each, whether their texts are equal or not; a null
    doc_id stays null and counts for no group's smallest.  Other columns are not read.
    """
    own = durable(sets(docs))
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = durable(shared(docs, max(8, math.ceil(total / BUCKET_SHINGLES)), percent))
    settle(docs.sparkSession)
    parts = connected_components(links(found, percent))
    same = own.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"))
    same = same.join(parts, same["key"] == parts["node"], "left").select("key", "first", F.coalesce("component", "key").alias("group"))
    first = same.groupBy("group").agg(F.min("first").alias("component_id"))
    same = same.join(first, "group").select("key", "component_id")
    return own.join(same, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
