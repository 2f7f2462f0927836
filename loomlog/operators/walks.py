"""Payloads as rows: every value, key by key, down to a depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import with_doc

#: How deep values are read; keys one level more are still seen.
DEPTH = 8


def _kind(value: Column) -> Column:
    # the type's first word tells; what is inside does not matter
    word = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
    return F.when(word == "VOID", "null").when(word == "OBJECT", "object").when(word == "ARRAY", "list").when(word == "STRING", "string").when(word == "BOOLEAN", "boolean").otherwise("number")


def walk(events: DataFrame, keys: tuple[str, ...], depth: int = DEPTH) -> DataFrame:
    """``keys``, path, depth, key, kind and value of everything in the payloads of events.

    ``path`` has the place at each level (an object's fields in the order of
    their names), ``key`` is null in lists, and ``value`` is the text of what is
    neither an object nor a list; JSON's null and what lies deeper than
    ``depth`` have none.  Bad JSON gives no row.  Each level puts the children
    of the containers that the level before has found beside the rows that are
    there: one scan, no shuffle, and no row goes through Python.
    """
    node = lambda path, key, value: F.struct(path.alias("path"), key.alias("key"), value.alias("v"), _kind(value).alias("kind"))
    path, value = F.col("n.path"), F.col("n.v")
    field = lambda e, i: node(F.concat(path, F.array(i)), e["key"], e["value"])
    item = lambda v, i: node(F.concat(path, F.array(i)), F.lit(None).cast("string"), v)
    fields = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), field)
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), item)
    top = with_doc(events).where("doc is not null")
    rows = top.select(*keys, node(F.array().cast("array<int>"), F.lit(None).cast("string"), F.col("doc")).alias("n"))
    for level in range(depth + 1):
        new = F.size(path) == level
        below = F.when(new & (F.col("n.kind") == "object"), fields).when(new & (F.col("n.kind") == "list"), items)
        own = F.array(F.col("n"))
        rows = rows.select(*keys, F.explode(F.when(below.isNull(), own).otherwise(F.concat(own, below))).alias("n"))
    known = ~F.col("n.kind").isin("object", "list") & (F.size(path) <= depth)
    return rows.select(*keys, path.alias("path"), F.size(path).alias("depth"), F.col("n.key").alias("key"), F.col("n.kind").alias("kind"), F.when(known, F.try_variant_get(value, "$", "string")).alias("value"))


def searchable(events: DataFrame, keys: tuple[str, ...], depth: int = DEPTH) -> DataFrame:
    """``keys`` and text: all keys and values of each payload, a line each, by path; a key before its value."""
    rows = walk(events, keys, depth).where("key is not null or value is not null")
    line = F.concat_ws("\n", "key", "value")
    lines = F.array_sort(F.collect_list(F.struct("path", line.alias("line"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
