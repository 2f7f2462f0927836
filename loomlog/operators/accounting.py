"""Tokens and their cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import SESSION, deltas, forward_fill

#: The counters of a bucket, and the price categories.
COUNTERS = ("input_tokens", "output_tokens", "total_tokens", "cached_input_tokens", "cache_creation_tokens", "reasoning_output_tokens")
PRICES = ("input", "cache_create", "cache_read", "output")
#: A rate table is broadcast up to this many rows, and matched by its keys' own lookup beyond.
MAX_RATES = 5_000


def parse_usage(usage: Column) -> Column:
    """Counters of a usage object given as JSON text; absent ones are 0."""
    v = F.try_parse_json(usage)
    number = lambda *keys: sum((F.coalesce(F.try_variant_get(v, f"$.{k}", "bigint"), F.lit(0)) for k in keys), F.lit(0))
    nested = F.coalesce(F.aggregate(F.map_values(F.from_json(F.get_json_object(usage, "$.cache_creation"), "map<string,bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(0))
    created = F.coalesce(F.try_variant_get(v, "$.cache_creation_input_tokens", "bigint"), nested)
    return F.struct(
        number("input_tokens").alias("input_tokens"), number("output_tokens").alias("output_tokens"), number("total_tokens").alias("total_tokens"),
        number("cached_input_tokens", "cache_read_input_tokens").alias("cached_input_tokens"), created.alias("cache_creation_tokens"), number("reasoning_output_tokens").alias("reasoning_output_tokens"),
    )


def usage_by_message(lines: DataFrame) -> DataFrame:
    """Buckets by model from raw lines (host, session_id, ord, message_id, request_id, model, usage, cost_usd).

    A message that is logged more than once counts once, by its first line.
    """
    both = F.col("message_id").isNotNull() & F.col("request_id").isNotNull()
    key = F.when(both, F.concat_ws("\0", "message_id", "request_id")).otherwise(F.concat(F.lit("line "), F.col("ord").cast("string")))
    first = F.row_number().over(Window.partitionBy(*SESSION, key).orderBy("ord"))
    rows = lines.withColumn("_first", first).where("_first = 1").withColumn("_u", parse_usage(F.col("usage")))
    rows = rows.where(F.coalesce(F.col("model"), F.lit("")) != "<synthetic>")
    return rows.groupBy(*SESSION, F.coalesce("model", F.lit("unknown")).alias("model")).agg(*[F.sum(F.col("_u")[c]).alias(c) for c in COUNTERS], F.sum("cost_usd").alias("embedded_cost"))


def usage_by_total(events: DataFrame) -> DataFrame:
    """Buckets by model from running totals (host, session_id, ord, model, cumulative counters, and last_<counter> where a turn's own usage is logged).

    Rows without a model take the last one named.  A turn counts by its own
    usage, else by what the counter grew since the last reading; rows in which
    nothing grew are left out.  A session of which nothing else counted has its
    last totals.
    """
    rows = events.withColumn("_model", F.coalesce(forward_fill(F.col("model"), "ord"), F.lit("unknown")))
    reading = F.coalesce(*[F.col(c).isNotNull() for c in COUNTERS[:1]])
    own = [f"last_{c}" for c in COUNTERS if f"last_{c}" in events.columns]
    given = F.coalesce(*[F.col(c) for c in own]).isNotNull() if own else F.lit(False)
    grown = {c: F.coalesce(deltas(F.col(c), "ord"), F.lit(0)) for c in COUNTERS}
    said = {c: F.coalesce(F.col(f"last_{c}"), F.lit(0)) if f"last_{c}" in own else F.lit(0) for c in COUNTERS}
    rows = rows.select(*SESSION, "ord", "_model", reading.alias("_reading"), *[F.when(given, said[c]).otherwise(grown[c]).alias(c) for c in COUNTERS], *[F.col(c).alias(f"_total_{c}") for c in COUNTERS])
    counts = rows.where(F.greatest(*[F.col(c) for c in COUNTERS]) > 0)
    sums = counts.groupBy(*SESSION, F.col("_model").alias("model")).agg(*[F.sum(c).alias(c) for c in COUNTERS])
    last = rows.where("_reading").groupBy(*SESSION).agg(F.max_by(F.struct("_model", *[f"_total_{c}" for c in COUNTERS]), "ord").alias("_last"))
    none = last.join(counts.select(*SESSION).distinct(), list(SESSION), "left_anti")
    rest = none.select(*SESSION, F.col("_last._model").alias("model"), *[F.coalesce(F.col(f"_last._total_{c}"), F.lit(0)).alias(c) for c in COUNTERS])
    return sums.unionByName(rest.where(F.greatest(*[F.col(c) for c in COUNTERS]) > 0))


def fallback_bucket(buckets: DataFrame, totals: DataFrame, models: DataFrame) -> DataFrame:
    """Buckets by model; a session that has totals only gets one bucket of its cost model, or of unknown.

    ``totals`` has the session's counters, ``models`` its cost_model.
    """
    only = totals.join(buckets.select(*SESSION).distinct(), list(SESSION), "left_anti").where(F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in COUNTERS]) > 0)
    named = only.join(models.select(*SESSION, "cost_model"), list(SESSION), "left")
    columns = [c for c in buckets.columns if c not in (*SESSION, "model")]
    return buckets.unionByName(named.select(*SESSION, F.coalesce("cost_model", F.lit("unknown")).alias("model"), *[F.col(c) if c in totals.columns else F.lit(None).alias(c) for c in columns]))


def total_tokens() -> Column:
    parts = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens") + F.col("cached_input_tokens")
    return F.when(F.coalesce(F.col("total_tokens"), F.lit(0)) > 0, F.col("total_tokens")).otherwise(parts)


def rates_for(models: DataFrame, rates: DataFrame) -> DataFrame:
    """(model, the four rates) of distinct models.

    ``rates`` has key, tier (0: snapshot, 1: default) and rates a million
    tokens.  An exact key wins over the longest key contained in the model's
    name, a snapshot over a default; without any the rates are 0.  Only the
    distinct models meet the rates, never the events.
    """
    m = models.select("model").distinct()
    small = rates.count() <= MAX_RATES
    priced = F.broadcast(rates) if small else rates
    contained = priced.where("key <> 'unknown'")
    # all keys that a name can contain are its substrings: with many rates those are looked up instead
    if small:
        met = m.join(contained, F.contains(m["model"], contained["key"]))
    else:
        size = F.length("model")
        parts = m.select("model", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substring(F.col("model"), i, n))))).alias("key")).distinct()
        met = parts.join(contained, "key")
    exact = (F.col("key") == F.col("model")).cast("int")
    best = F.max_by(F.struct(*PRICES), F.struct(-F.col("tier"), exact, F.length("key"), F.col("key")))
    found = met.groupBy("model").agg(best.alias("r")).select("model", *[F.col("r")[p].alias(p) for p in PRICES])
    return m.join(found, "model", "left").fillna(0.0, list(PRICES))


def price(buckets: DataFrame, rates: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Buckets with the cost of each category and their sum.

    Of host B the input holds the cached tokens, which are taken off first.
    ``models``, if given, has every model of the buckets, so that these are read
    once; others may be in it.
    """
    known = rates_for(buckets if models is None else models, rates)
    if models is not None and models.select("model").distinct().limit(MAX_RATES + 1).count() <= MAX_RATES:
        known = F.broadcast(known)
    fresh = F.when(F.col("host") == "codex", F.greatest(F.lit(0), F.col("input_tokens") - F.col("cached_input_tokens"))).otherwise(F.col("input_tokens"))
    counts = {"input": fresh, "cache_create": F.col("cache_creation_tokens"), "cache_read": F.col("cached_input_tokens"), "output": F.col("output_tokens")}
    df = buckets.join(known, "model")
    df = df.select(*buckets.columns, *[(n * F.col(c) / 1e6).alias(f"cost_{c}") for c, n in counts.items()])
    return df.withColumn("cost", sum((F.col(f"cost_{c}") for c in PRICES[1:]), F.col(f"cost_{PRICES[0]}")))


def session_cost(priced: DataFrame, mode: str = "auto", places: int | None = 6) -> DataFrame:
    """Cost of each session: display shows the embedded one, calculate the priced one, auto the embedded one if there.

    Categories of an embedded cost are the priced ones, scaled to it.  Amounts
    are rounded half-even to ``places``, or not at all.
    """
    if mode not in ("auto", "calculate", "display"):
        raise ValueError(mode)
    embedded = F.sum("embedded_cost") if "embedded_cost" in priced.columns else F.lit(None).cast("double")
    df = priced.groupBy(*SESSION).agg(F.sum("cost").alias("_cost"), embedded.alias("_embedded"), *[F.sum(f"cost_{c}").alias(f"_{c}") for c in PRICES])
    shown = F.lit(False) if mode == "calculate" else F.col("_embedded").isNotNull()
    own = F.when(shown, F.col("_embedded")).otherwise(F.lit(None).cast("double") if mode == "display" else F.col("_cost"))
    scale = F.when(F.col("_cost") > 0, own / F.col("_cost"))
    part = lambda c: F.coalesce(F.col(f"_{c}") * scale, own if c == "input" else F.lit(0.0), F.lit(0.0))
    source = F.when(shown, "embedded").otherwise("empty" if mode == "display" else "calculated")
    rounded = lambda c: c if places is None else F.bround(c, places)
    return df.select(*SESSION, rounded(own).alias("total"), *[rounded(part(c)).alias(c) for c in PRICES], source.alias("source"))


def shares(costs: DataFrame) -> DataFrame:
    """Percent of each category of all costs."""
    sums = costs.agg(*[F.sum(c).alias(c) for c in PRICES])
    whole = sum((F.col(c) for c in PRICES[1:]), F.col(PRICES[0]))
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("category"), F.bround(F.col(c) / F.nullif(whole, F.lit(0.0)) * 100, 4).alias("percent")) for c in PRICES])))
