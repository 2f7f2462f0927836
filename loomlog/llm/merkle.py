"""A Merkle manifest of a dataset: a tree a group of rows, a tree over the groups, and each row's proof.

Rows are ranked within their group by a range partitioning and counts of its
parts, so that no group is one task.  The tree is built from below in storeys
of ``BITS`` binary levels: 2 ** BITS consecutive nodes become one node of the
next storey, and every storey is persisted.  Proofs come from above: each
storey's nodes meet the proof of the node over them, and each child puts its
siblings before the suffix that it inherits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Binary levels of a storey: a task holds 2 ** BITS nodes of a group at a time.
BITS = 10
#: Parts of groups that are broadcast to the rows; beyond, both are joined by shuffle.
MAX_PARTS = 100_000
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(column: Column) -> Column:
    """``-`` for null, else the bytes of the value as UTF-8, a colon, the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*columns: Column) -> Column:
    """sha256 of the encoded columns, as lowercase hex."""
    return F.sha2(F.concat(*[encoded(c) for c in columns]).cast("binary"), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes: list[str], most: int | None) -> list[list[str]]:
    """The levels over consecutive nodes, these first: ``most`` of them, or (None) until one node is left."""
    out = [nodes]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        row = out[-1]
        out.append([_hash("".join(row[i : i + 2])) for i in range(0, len(row), 2)])
    return out


def siblings(rows: list[list[str]], at: int) -> list[str]:
    """What stands beside the path of node ``at``, a level an entry: ``<`` or ``>`` (to the left, right) and the digest, or nothing."""
    out = []
    for row in rows[:-1]:
        other = at ^ 1
        out.append("" if other >= len(row) else (">" if at % 2 == 0 else "<") + row[other])
        at //= 2
    return out


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``idx``, the place from 0 in their ``grp`` by ``order``, and ``n``, the rows of it.

    Equal rows are taken apart by where they stand, so no value is one task.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = durable(rows).withColumn("_tie", F.monotonically_increasing_id())
    by = ["grp", *order, "_tie"]
    dealt = rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    placed = durable(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    of = Window.partitionBy("grp")
    before = F.sum("_rows").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = durable(parts.select("grp", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(of).alias("n")))
    if parts.limit(MAX_PARTS + 1).count() <= MAX_PARTS:
        parts = F.broadcast(parts)
    return placed.join(parts, ["grp", "_part"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _climb(nodes: DataFrame, bits: int) -> DataFrame:
    """The next storey: (grp, idx, n, node)."""

    def top(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        n = table["n"][0].as_py()
        whole = n <= 1 << bits
        root = levels(table["node"].to_pylist(), None if whole else bits)[-1][0]
        return pa.table({"grp": [table["grp"][0].as_py()], "idx": [table["idx"][0].as_py() >> bits], "n": [-(-n >> bits)], "node": [root]}, schema=pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("node", pa.string())]))

    rows = nodes.select("grp", "idx", "n", "node", F.shiftright("idx", bits).alias("_over"))
    return rows.groupBy("grp", "_over").applyInArrow(top, "grp string, idx long, n long, node string")


def _descend(nodes: DataFrame, over: DataFrame, bits: int) -> DataFrame:
    """The nodes with what the node over them has: ``proof`` behind their own siblings, and its other columns as they are."""
    columns = [f for f in nodes.schema.fields if f.name != "_over"]
    more = [f for f in over.schema.fields if f.name not in ("grp", "idx", "n", "node", "proof")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*columns, *more]) + ", proof array<string>"
    names = [f.name for f in more]

    def push(below: pa.Table, above: pa.Table) -> pa.Table:
        below = below.drop_columns("_over").sort_by("idx")
        whole = below.num_rows and below["n"][0].as_py() <= 1 << bits
        rows = levels(below["node"].to_pylist(), None if whole else bits)
        suffix = above["proof"][0].as_py()
        out = below
        for name in names:
            out = out.append_column(name, pa.repeat(above[name][0], below.num_rows))
        proofs = [siblings(rows, i) + suffix for i in range(below.num_rows)]
        return out.append_column("proof", pa.array(proofs, pa.list_(pa.string())))

    down = nodes.withColumn("_over", F.shiftright("idx", bits)).groupBy("grp", "_over")
    up = over.select("grp", F.col("idx").alias("_over"), "proof", *names).groupBy("grp", "_over")
    return down.cogroup(up).applyInArrow(push, schema)


def _storeys(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The persisted storeys, up to where each group is one node."""
    out = [durable(nodes)]
    while len(out) == 1 or (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(durable(_climb(out[-1], bits)))
    return out


def _proven(storeys: list[DataFrame], over: DataFrame, bits: int) -> DataFrame:
    for k in range(len(storeys) - 2, -1, -1):
        over = _descend(storeys[k], over, bits)
        if k:
            over = durable(over)
    return over


def manifest(rows: DataFrame, group: str, key: str, leaf: str, bits: int = BITS) -> DataFrame:
    """``rows`` with ``idx`` (the place in the group), ``subroot``, ``root`` and ``proof``.

    Rows of a group stand by ``key``, null first; rows that repeat a key by
    their leaf, and equal ones each are a leaf of their own.  Two consecutive
    nodes become the sha256 of their digests' hex text, and the last one of an
    odd level that of its own; a group of one row is that row's leaf.  The
    subroots, by group (null first, then by UTF-8 bytes), make the root in the
    same way.  ``proof`` has an entry a level up to the root: ``<`` or ``>`` and
    the sibling to the left or right, or an empty one where there is none.
    Columns of ``rows`` with the names idx, n, grp, node, subroot, root or proof
    must not be there.  An empty table gives no rows.
    """
    named = rows.withColumn("grp", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")))
    named = named.withColumn("node", F.col(leaf))
    below = _storeys(_ranked(named, [key, "node"]), bits)
    tops = below[-1].select(F.lit("").alias("grp"), F.col("grp").alias("_name"), "node")
    above = _storeys(_ranked(tops, ["_name"]), bits)
    crown = above[-1].select("grp", "idx", F.col("node").alias("root"), F.array().cast("array<string>").alias("proof"))
    over = durable(_proven(above, crown, bits).select(F.col("_name").alias("grp"), F.lit(0).cast("long").alias("idx"), F.col("node").alias("subroot"), "root", "proof"))
    return _proven(below, over, bits).select(*rows.columns, "idx", "subroot", "root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    other = lambda p: F.substring(p, 2, 64)
    join = lambda node, p: F.when(p.startswith("<"), F.concat(other(p), node)).otherwise(F.concat(node, other(p)))
    return F.aggregate(proof, leaf, lambda node, p: F.sha2(join(node, p).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """sha256 of the siblings, one after another from the leaf's level up."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.substring(p, 2, 64)), "").cast("binary"), 256)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, lang, the leaf of each document, and the leaf after tampering where it is tampered with.

    A null field is ``-`` in the leaf, an empty text ``0:``.  Where 7 divides
    crc32 of doc_id, tampering adds 1 to n_chars; null ids and null counts stay.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = [F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in fields]
    other = F.when(hit & F.col("n_chars").isNotNull(), digest(*more))
    return docs.select("doc_id", "lang", digest(*[F.col(c) for c in fields]).alias("leaf"), other.alias("tampered"))


def audit(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each document; as ``manifest`` and ``leaves`` state."""
    proven = manifest(leaves(docs), "lang", "doc_id", "leaf", bits)
    found = proven.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = lambda n: "sha256(" + " || ".join(_FIELD(n if c == "n_chars" else c) for c in FIELDS) + ")"
_UP = lambda name: f"SELECT grp, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY grp, lvl, idx // 2, n"
#: crc32 of the decimal doc_id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))))"""
#: DuckDB SQL of ``audit`` over ``documents``.
SQL = f"""WITH RECURSIVE leaf AS (SELECT doc_id, coalesce('=' || lang, '-') AS grp, {_LEAF("n_chars")} AS leaf,
    CASE WHEN mod(crc, 7) = 0 AND n_chars IS NOT NULL THEN {_LEAF("(n_chars + 1)")} END AS tampered
  FROM (SELECT *, {_CRC} AS crc FROM documents)),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM leaf),
tree(grp, lvl, idx, n, h) AS (SELECT grp, 0, idx, n, leaf FROM placed UNION ALL {_UP("tree")}),
sub AS (SELECT grp AS name, lvl AS depth, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
crown(grp, lvl, idx, n, h) AS (SELECT '', 0, idx, n, subroot FROM sub UNION ALL {_UP("crown")}),
beside AS (
  SELECT p.grp, p.idx AS place, l.lvl, (p.idx >> l.lvl) % 2 = 1 AS after, t.h AS other FROM placed p JOIN (SELECT DISTINCT grp, lvl FROM tree WHERE n > 1) l ON l.grp = p.grp
    LEFT JOIN tree t ON t.grp = p.grp AND t.lvl = l.lvl AND t.idx = xor(p.idx >> l.lvl, 1)
  UNION ALL SELECT p.grp, p.idx, s.depth + l.lvl, (s.idx >> l.lvl) % 2 = 1, t.h FROM placed p JOIN sub s ON s.name = p.grp JOIN (SELECT DISTINCT lvl FROM crown WHERE n > 1) l ON true
    LEFT JOIN crown t ON t.lvl = l.lvl AND t.idx = xor(s.idx >> l.lvl, 1)),
proof AS (SELECT grp, place, coalesce(string_agg(other, '' ORDER BY lvl), '') AS siblings FROM beside GROUP BY grp, place),
fold(grp, place, lvl, h) AS (SELECT grp, idx, 0, coalesce(tampered, leaf) FROM placed
  UNION ALL SELECT f.grp, f.place, f.lvl + 1, sha256(CASE WHEN b.after THEN b.other || f.h ELSE f.h || coalesce(b.other, '') END) FROM fold f JOIN beside b ON b.grp = f.grp AND b.place = f.place AND b.lvl = f.lvl),
ends AS (SELECT grp, place, max_by(h, lvl) AS folded_root FROM fold GROUP BY grp, place)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, sha256(coalesce(q.siblings, '')) AS proof_sha256, e.folded_root, e.folded_root = r.h AS verified
FROM placed p JOIN sub s ON s.name = p.grp JOIN ends e ON e.grp = p.grp AND e.place = p.idx LEFT JOIN proof q ON q.grp = p.grp AND q.place = p.idx CROSS JOIN (SELECT h FROM crown WHERE n = 1) r"""
