"""Pricing of events by the longest price-table id that begins their model's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import CLASSES, NANO, class_cost, price_to_nano

#: Rows of a price table; a table with more is refused, so that broadcasting it stays cheap.
MAX_CARDS = 20_000
CARD = "model_id string, display_name string, input string, output string, cache_write string, cache_read string"


def cards(table: DataFrame) -> DataFrame:
    """``table`` (CARD, prices as decimal strings) -> prices in nano-USD per million tokens.

    A missing cache price is the input price, and ``cache_fallback`` says that one of them was missing.
    """
    if table.count() > MAX_CARDS:
        raise ValueError(f"a price table has at most {MAX_CARDS} models")
    nano = {f"{c}_nano": price_to_nano(F.col(c)) for c in CLASSES}
    out = table.select("model_id", "display_name", *[v.alias(k) for k, v in nano.items()])
    missing = F.col("cache_write_nano").isNull() | F.col("cache_read_nano").isNull()
    return out.select(
        "model_id", "display_name", "input_nano", "output_nano",
        F.coalesce("cache_write_nano", "input_nano").alias("cache_write_nano"), F.coalesce("cache_read_nano", "input_nano").alias("cache_read_nano"),
        missing.alias("cache_fallback"),
    )


def match_models(models: DataFrame, price_cards: DataFrame) -> DataFrame:
    """``models`` (model, distinct) with the longest matching card; null where there is none."""
    cols = price_cards.columns
    pairs = models.join(F.broadcast(price_cards), F.col("model").startswith(F.col("model_id")), "left")
    best = pairs.groupBy("model").agg(F.max_by(F.struct(*cols), F.length("model_id")).alias("c"))
    return best.select("model", *[f"c.{c}" for c in cols])


def breakdown(prefix: str = "cost_") -> list[Column]:
    """Four class costs and their sum; each class is floored once."""
    parts = {c: class_cost(F.col(c), F.col(f"{c}_nano")) for c in CLASSES}
    total = sum((parts[c] for c in CLASSES[1:]), parts[CLASSES[0]]).cast(NANO)
    return [*[v.alias(f"{prefix}{c}") for c, v in parts.items()], total.alias(f"{prefix}total")]


def known_models(events: DataFrame, price_cards: DataFrame) -> DataFrame:
    """The models of ``events`` with their cards, as ``price`` takes them."""
    return match_models(events.select("model").distinct(), price_cards).withColumnRenamed("model_id", "price_id")


def price(events: DataFrame, price_cards: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``events`` with price_id, display_name, card prices and costs; all null for an unknown model.  ``known`` has
    ``known_models`` of them if the caller has found these already."""
    known = known_models(events, price_cards) if known is None else known
    return events.join(known, "model", "left").select(*events.columns, "price_id", "display_name", "input_nano", "cache_read_nano", "cache_fallback", *breakdown())


def reprice(events: DataFrame, card: DataFrame) -> DataFrame:
    """``events`` with repriced_* costs on one card, whatever their own model."""
    return events.drop(*[c for c in card.columns if c in events.columns]).crossJoin(F.broadcast(card.limit(1))).select(*[c for c in events.columns if c not in card.columns], "cache_fallback", *breakdown("repriced_"))
