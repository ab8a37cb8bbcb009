"""Price tables: the bundled form, its validation, and the conversion of a community feed."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, SparkSession

from ..operators.pricing import CARD

_PRICE = re.compile(r"\d+(\.\d{1,9})?")
_FIELDS = {"inputPerMTok": True, "outputPerMTok": True, "cacheWritePerMTok": False, "cacheReadPerMTok": False}


class PriceError(ValueError):
    pass


def validate(data, label: str = "price table") -> tuple[dict, list[str]]:
    """The table and warnings on keys it does not know; raises where it is wrong."""
    if not isinstance(data, dict) or data.get("schemaVersion") != 1 or not isinstance(data.get("models"), dict):
        raise PriceError(f"{label}: schemaVersion 1 and models are needed")
    for key in ("asOf", "source"):
        if not isinstance(data.get(key), str):
            raise PriceError(f"{label}: {key} must be a string")
    warnings = [f"{label}: unknown key {k!r}" for k in data if k not in ("schemaVersion", "asOf", "source", "models")]
    for model, card in data["models"].items():
        if not isinstance(card, dict) or not isinstance(card.get("displayName"), str):
            raise PriceError(f"{label}: {model} needs a displayName")
        for field, needed in _FIELDS.items():
            value = card.get(field)
            if value is None and not needed and field not in card:
                continue
            if not isinstance(value, str) or not _PRICE.fullmatch(value.strip()):
                raise PriceError(f"{label}: {model}.{field} must be a decimal string of at most nine decimals")
        warnings += [f"{label}: unknown key {k!r} of {model}" for k in card if k != "displayName" and k not in _FIELDS]
    return data, warnings


def to_frame(spark: SparkSession, table: dict) -> DataFrame:
    rows = [(m, c["displayName"], *(c.get(f) for f in _FIELDS)) for m, c in table["models"].items()]
    return spark.createDataFrame(rows, CARD)


def load(spark: SparkSession, bundled: dict, user_path: str | None = None) -> tuple[DataFrame, dict[str, str], list[str]]:
    """(cards, {origin, asOf}, warnings): the user's table if it is valid, else the bundled one and a warning."""
    warnings: list[str] = []
    if user_path and os.path.exists(user_path):
        try:
            with open(user_path, encoding="utf-8") as f:
                table, warnings = validate(json.load(f), user_path)
            return to_frame(spark, table), {"asOf": table["asOf"], "origin": "refreshed"}, warnings
        except (OSError, ValueError) as e:
            warnings = [f"{e}; the bundled prices are used"]
    table, more = validate(bundled, "bundled prices")
    return to_frame(spark, table), {"asOf": table["asOf"], "origin": "bundled"}, warnings + more


def price_string(nano: int) -> str:
    if nano < 0:
        raise PriceError("a price cannot be negative")
    whole, part = divmod(nano, 10**9)
    return f"{whole}.{part:09d}".rstrip("0").rstrip(".") if part else str(whole)


def per_million(cost) -> str:
    """A per-token price as a decimal string per million: twelve significant digits, then nine decimals,
    halves up."""
    if isinstance(cost, bool) or not isinstance(cost, (int, float)) or not 0 <= cost < float("inf"):
        raise PriceError(f"no price: {cost!r}")
    plain = Decimal(f"{cost * 1e6:.11e}")
    return price_string(int((plain * 10**9).to_integral_value(ROUND_HALF_UP)))


def feed_id(key: str, provider: str | None) -> str | None:
    """The model id of a feed's row, or None if its provider or name is out of scope."""
    if provider == "anthropic":
        return key if key.startswith("claude-") else None
    if provider == "openai":
        return key if re.match(r"gpt-|o[0-9]|codex-|chatgpt-", key) and "/" not in key else None
    if provider in ("gemini", "deepseek"):
        head = {"gemini": "gemini/gemini-", "deepseek": "deepseek/"}[provider]
        return key.partition("/")[2] if key.startswith(head) else None
    if provider in ("dashscope", "alibaba"):
        name = key.partition("/")[2] or key
        return name if "qwen" in name and "coder" in name else None
    return None


def convert_feed(data) -> dict[str, dict]:
    """Cards from a feed (untrusted): chat and responses models with both main prices; keys in order,
    the first of an id wins; a bad cache price is left out, never made up."""
    if not isinstance(data, dict):
        raise PriceError("the feed is no object of models")
    numbers = {"inputPerMTok": "input_cost_per_token", "outputPerMTok": "output_cost_per_token", "cacheWritePerMTok": "cache_creation_input_token_cost", "cacheReadPerMTok": "cache_read_input_token_cost"}
    out: dict[str, dict] = {}
    for key in sorted(data):
        row = data[key]
        if key == "sample_spec" or not isinstance(row, dict):
            continue
        typed = all(isinstance(row.get(k, ""), str) for k in ("litellm_provider", "mode"))
        typed &= all(isinstance(row.get(k, 0), (int, float)) and not isinstance(row.get(k, 0), bool) for k in numbers.values())
        ident = feed_id(key, row.get("litellm_provider")) if typed else None
        if ident is None or ident in out or row.get("mode") not in ("chat", "responses"):
            continue
        card = {"displayName": ident}
        for field, source in numbers.items():
            try:
                if source in row:
                    card[field] = per_million(row[source])
            except PriceError:
                pass
        if "inputPerMTok" in card and "outputPerMTok" in card:
            out[ident] = card
    return out


def refresh(path: str, fetch: Callable[[], object], as_of: str, source: str) -> dict:
    """Writes a fetched and converted table in one step; an empty one is refused, the old file stays."""
    models = convert_feed(fetch())
    if not models:
        raise PriceError("the feed has no usable model")
    table, _ = validate({"schemaVersion": 1, "asOf": as_of, "source": source, "models": models})
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(table, f, indent=2, sort_keys=True)
    os.replace(temporary, path)
    return table
