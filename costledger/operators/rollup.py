"""Rollups of the ledger.  Each is one partial and one final aggregate, in ``n`` parts one after another where asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import CLASSES, NANO
from .events import total_tokens
from .tables import in_parts

COSTS = [f"cost_{c}" for c in (*CLASSES, "total")]


def _long(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def _money(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0).cast(NANO)).cast(NANO)


def measures(models: bool = True) -> list[Column]:
    """Counts, token and money sums.  Unpriced events are counted, never costed."""
    unpriced = F.col("cost_total").isNull()
    side = F.col("is_sidechain")
    out = [F.count("*").alias("events")]
    out += [_long(F.col(c)).alias(f"{c}_tokens") for c in CLASSES]
    out += [_money(F.col(c)).alias(c) for c in COSTS]
    out += [_long(F.when(unpriced, 1)).alias("unpriced_events"), _long(F.when(unpriced, total_tokens())).alias("unpriced_tokens")]
    out += [F.count_distinct("session_id").alias("sessions")]
    out += [F.sort_array(F.collect_set("model")).alias("models")] if models else []
    out += [_long(F.when(side, total_tokens())).alias("subagent_tokens"), _money(F.when(side, F.col("cost_total"))).alias("subagent_cost")]
    return [*out, F.min("ts_ms").alias("min_ts_ms"), F.max("ts_ms").alias("max_ts_ms")]


def unpriced_tokens() -> list[Column]:
    """Tokens of unpriced events by class, named as the sums of all are."""
    return [_long(F.when(F.col("cost_total").isNull(), F.col(c))).alias(f"{c}_tokens") for c in CLASSES]


def rollup(ledger: DataFrame, *keys: str, models: bool = True) -> DataFrame:
    return ledger.groupBy(*keys).agg(*measures(models))


def _united(parts: DataFrame, *keys: str) -> DataFrame:
    """One rollup from those of parts that share no session."""

    def of(name: str, kind: str) -> Column:
        if name == "models":
            return F.sort_array(F.array_distinct(F.flatten(F.collect_list(name))))
        if name in ("min_ts_ms", "max_ts_ms"):
            return F.min(name) if name == "min_ts_ms" else F.max(name)
        return _money(F.col(name)) if kind == NANO else _long(F.col(name))

    return parts.groupBy(*keys).agg(*[of(c, t).alias(c) for c, t in parts.dtypes if c not in keys])


def _by_parts(ledger: DataFrame, n: int, *keys: str, models: bool = True) -> DataFrame:
    """``rollup`` of few groups, in ``n`` parts of whole sessions."""
    made = in_parts(ledger.sparkSession, lambda keep: rollup(ledger.where(keep("session_id")), *keys, models=models), n)
    return made if n == 1 else _united(made, *keys)


def total(ledger: DataFrame, n: int = 1) -> DataFrame:
    return _by_parts(ledger, n)


def by_commit(ledger: DataFrame, n: int = 1) -> DataFrame:
    rows = ledger.where("kind = 'commit'")
    return in_parts(ledger.sparkSession, lambda keep: rollup(rows.where(keep("repo_id", "hash")), "repo_id", "hash"), n)


def by_model(ledger: DataFrame, n: int = 1) -> DataFrame:
    return _by_parts(ledger, n, "repo_id", "model", models=False)


def by_session(ledger: DataFrame, n: int = 1) -> DataFrame:
    return in_parts(ledger.sparkSession, lambda keep: rollup(ledger.where(keep("repo_id", "session_id")), "repo_id", "session_id"), n)


def bucket() -> Column:
    """What is shown as a bucket: commits, waste, what is in progress (no waste yet), overhead."""
    return F.when(F.col("kind") == "commit", "attributed").when((F.col("kind") == "waste") & F.col("in_progress"), "in_progress").otherwise(F.col("kind"))


def by_bucket(ledger: DataFrame, names: tuple[str, ...] = ("attributed", "waste", "in_progress", "overhead")) -> DataFrame:
    """A row for each bucket, empty ones too."""
    spark = ledger.sparkSession
    all_ = spark.createDataFrame([(n,) for n in names], "bucket string")
    got = rollup(ledger.withColumn("bucket", bucket()), "bucket", models=False)
    zeros = {c: 0 for c, t in got.dtypes if t == "bigint" and "ts_ms" not in c}
    out = all_.join(got, "bucket", "left").na.fill(zeros)
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast(NANO)) for c, t in got.dtypes if t == NANO})


def unpriced_models(ledger: DataFrame) -> DataFrame:
    return ledger.where("cost_total is null").groupBy("model").agg(F.count("*").alias("events"), _long(total_tokens()).alias("tokens"))


def _weights() -> list[Column]:
    return [_long(F.when(F.col("confidence") == level, total_tokens())) for level in ("high", "medium", "low")]


def dominant_confidence() -> Column:
    """By tokens; of equal weights the lower level."""
    high, medium, low = _weights()
    return F.when(high > F.greatest(medium, low), "high").when(medium > low, "medium").otherwise("low")


def report_confidence() -> Column:
    """As the markdown ledger has it: of equal weights the higher level, none without tokens' events."""
    high, medium, low = _weights()
    known = F.count(F.col("confidence"))
    return F.when(known == 0, "—").when(high >= F.greatest(medium, low), "high").when(medium >= low, "medium").otherwise("low")


def provenance_counts(ledger: DataFrame) -> DataFrame:
    count = lambda p: F.count(F.when(F.col("provenance") == p, 1)).alias(p)
    return ledger.agg(count("measured"), count("repriced"), count("advisory"))


def cache_savings(ledger: DataFrame) -> DataFrame:
    """What cache reads saved against the input price, floored per event; where they cost more, nothing."""
    from ..functions.money import class_cost

    gap = F.col("input_nano") - F.col("cache_read_nano")
    saved = F.when(gap > 0, class_cost(F.col("cache_read"), gap))
    return ledger.agg(_long(F.col("cache_read")).alias("cache_read_tokens"), _long(F.col("input")).alias("input_tokens"), _money(saved).alias("saved_nano"))


def percent1(part: Column, whole: Column) -> Column:
    """One decimal, halves up; null unless the whole is positive."""
    return F.when(whole > 0, F.floor(part / whole * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0))


def delta_percent(measured: Column, repriced: Column) -> Column:
    """Signed, one decimal, cut off toward zero from exact thousandths; null if nothing was measured."""
    change = (repriced - measured).cast(NANO) * F.lit(1000).cast("decimal(4,0)")
    size = F.abs(change)
    thousandths = ((size - size % measured) / measured).cast(NANO)
    negative = (change < 0) & (thousandths > 0)
    text = F.concat(((thousandths - thousandths % 10) / 10).cast(NANO).cast("string"), F.lit("."), (thousandths % 10).cast(NANO).cast("string"))
    return F.when(measured != 0, F.concat(F.when(negative, "-").otherwise("+"), text))


def top_model(ledger: DataFrame) -> DataFrame:
    """The model with the most tokens; of equal ones the lesser name."""
    per = ledger.groupBy("model").agg(_long(total_tokens()).alias("tokens"))
    return per.agg(F.min_by(F.struct("model", "tokens"), F.struct(-F.col("tokens"), F.col("model"))).alias("t")).select("t.model", "t.tokens")


def conservation(ledger: DataFrame, tally: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Bucket sums, and whether they account for every token: of the ledger itself, and with ``raw``
    (the events that went into it) of what was read.  A row of an unknown kind shows as a delta."""
    part = lambda k: _long(F.when(F.col("kind") == k, total_tokens())).alias(k)
    sums = ledger.agg(part("commit"), part("waste"), part("overhead"), part("out_of_scope"), _long(total_tokens()).alias("all_tokens"))
    read = (raw if raw is not None else ledger).agg(_long(total_tokens()).alias("in_tokens"))
    out = sums.crossJoin(F.broadcast(tally.select("oos_tokens"))).crossJoin(F.broadcast(read))
    oos = F.col("out_of_scope") + F.col("oos_tokens")
    placed = F.col("commit") + F.col("waste") + F.col("overhead") + oos
    return out.select(
        F.col("commit").alias("attributed"), "waste", "overhead", oos.alias("out_of_scope"), (F.col("all_tokens") + F.col("oos_tokens") - placed).alias("delta"),
        (F.col("in_tokens") + F.col("oos_tokens")).alias("raw_tokens"), placed.alias("ledger_tokens"), (F.col("in_tokens") + F.col("oos_tokens") - placed).alias("mismatch_tokens"),
        (F.col("in_tokens") + F.col("oos_tokens") == placed).alias("ok"),
    )
