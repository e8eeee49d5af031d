"""Prices of cards by condition, and conversion between currencies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .ranking import richest_variant
from .rules import BAND_FACTORS, condition_band

#: What is paid for a card as a share of what it sells for.
BUY_SHARE = 0.75


def converted(amounts: DataFrame, rates: DataFrame, amount: str = "amount", currency: str = "currency") -> DataFrame:
    """A row for each amount and target that has a rate from the amount's currency, with value = amount x rate."""
    r = rates.select(F.col("base").alias(currency), "target", "rate")
    return amounts.join(r, currency).withColumn("value", F.col(amount) * F.col("rate"))


def live_rates(rates: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """Rates that were fetched less than ``hours`` before ``now``."""
    return rates.where(F.col("fetched_at") > now - F.expr(f"INTERVAL {int(hours)} HOURS"))


def price_base(usd: list[Column], eur: list[Column], eur_to_target: Column | None = None) -> dict[str, Column]:
    """base_price and base_currency: the first price in dollars, else the first in euros, converted if a rate is known."""
    dollars, euros = F.coalesce(*usd), F.coalesce(*eur)
    rate = F.lit(None).cast("double") if eur_to_target is None else eur_to_target
    return {
        "base_price": F.coalesce(dollars, euros * rate, euros),
        "base_currency": F.when(dollars.isNotNull(), "USD").when((euros * rate).isNotNull(), "MXN").when(euros.isNotNull(), "EUR"),
    }


# The fields of a block that holds prices itself, and of each market its currency, fields and preferred variants.
DIRECT_FIELDS = ("trend", "avg7", "avg30", "low", "marketPrice", "lowPrice", "midPrice", "highPrice")
MARKETS = {
    "cardmarket": ("EUR", ("trend", "avg7", "avg30", "low"), ("normal", "reverse", "holo")),
    "tcgplayer": ("USD", ("marketPrice", "lowPrice", "midPrice", "highPrice"), ("normal", "holo", "reverse")),
}


def price_fields(block: Column, preferred: Sequence[str]) -> Column:
    """The fields (a map of texts) of a market's JSON block: its own if it holds prices itself, else those of its richest
    variant among ``preferred``, else of its first variant.  Null where there is none, or no JSON object.
    """
    object_of = lambda x: F.from_json(x, "map<string,string>")

    def variants(s: Column) -> Column:
        # parsed with their texts at hand, as what is no object parses to null or to an empty map
        parsed = F.map_filter(F.transform_values(s["own"], lambda _, v: F.when(v.startswith("{"), object_of(v))), lambda _, v: v.isNotNull())
        return let(richest, block=s["block"], own=s["own"], variants=parsed)

    def richest(s: Column) -> Column:
        return let(chosen, block=s["block"], own=s["own"], first=F.get(F.map_values(s["variants"]), F.lit(0)), best=F.element_at(s["variants"], richest_variant(s["variants"], preferred)))

    def chosen(s: Column) -> Column:
        direct = F.arrays_overlap(F.map_keys(s["own"]), F.array(*map(F.lit, DIRECT_FIELDS)))
        one = F.when(direct, s["own"]).when(F.size(s["best"]) > 0, s["best"]).otherwise(s["first"])
        return let(lambda c: F.when(c["block"].startswith("{") & (F.size(c["one"]) > 0), c["one"]), block=s["block"], one=one)

    return let(lambda s: let(variants, block=s["block"], own=object_of(s["block"])), block=block)


def market_prices(prices: Column) -> dict[str, Column]:
    """For each market a struct of its currency and fields as numbers, from a card's JSON of prices; null where it has none."""

    def priced_in(currency: str, fields: Sequence[str]) -> Callable[[Column], Column]:
        return lambda s: F.when(s["found"].isNotNull(), F.struct(F.lit(currency).alias("currency"), *(F.element_at(s["found"], f).try_cast("double").alias(f) for f in fields)))

    found = {market: price_fields(F.get_json_object(prices, f"$.{market}"), preferred) for market, (_, _, preferred) in MARKETS.items()}
    return {market: let(priced_in(currency, fields), found=found[market]) for market, (currency, fields, _) in MARKETS.items()}


def band_factor(band: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, factor in BAND_FACTORS.items():
        out = F.when(band == name, factor).otherwise(out)
    return out


def priced(base_price: Column, score: Column, listed: Column | None = None) -> dict[str, Column]:
    """band, sale_price and buy_price; a price listed for the very condition goes before the base price times its factor."""
    band = condition_band(score)
    own = base_price * band_factor(band)
    sale = own if listed is None else F.coalesce(listed, own)
    return {"band": band, "sale_price": sale, "buy_price": sale * BUY_SHARE}
