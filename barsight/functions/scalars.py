"""Column functions: guards, rounding, names, sizing, verdicts, text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Null, NaN and infinite values are no numbers."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def guard(x: Column) -> Column:
    return F.when(finite(x), x)


def significant(x: Column, digits: int = 6) -> Column:
    """Rounded to so many significant digits as exact arithmetic would, exact halves to even; what is no number becomes null.

    The product with a power of ten is rounded to a double, so it may show a half that is none: the product's own rounding
    error, by Dekker's splitting of both factors, then decides.
    """
    x = x.cast("double")
    places = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    up, down = F.pow(F.lit(10.0), F.greatest(places, F.lit(0))), F.pow(F.lit(10.0), F.greatest(-places, F.lit(0)))

    def high(v: Column) -> Column:
        return v * 134217729.0 - (v * 134217729.0 - v)

    product = x * up
    xh, uh = high(x), high(up)
    xl, ul = x - xh, up - uh
    error = ((xh * uh - product) + xh * ul + xl * uh) + xl * ul
    scaled = product / down
    below = F.floor(scaled)
    error = F.when(down > 1, x - (below + 0.5) * down).otherwise(error)
    whole = F.when((scaled - below == 0.5) & (error > 0), below + 1).when((scaled - below == 0.5) & (error < 0), below).otherwise(F.rint(scaled))
    return F.when(x == 0, 0.0).when(finite(x), whole / up * down)


def file_name(symbol: Column) -> Column:
    return F.concat(F.translate(symbol, ".^", "_"), F.lit(".json"))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def lots(value: Column, price: Column, lot: int = 1) -> Column:
    """Whole lots that a value buys."""
    return (F.floor(value / price / lot) * lot).cast("bigint")


def size_shares(close: Column, vol20: Column, equity: Column, p) -> Column:
    """Shares of a new position: an equal slot of the equity, or a fixed risk over the stop's distance, capped."""
    if p.sizing == "risk":
        vol = F.when(vol20 > 0, vol20).otherwise(0.02)
        distance = F.greatest(p.stop_vol_mult * vol * close, close * 0.02)
        value = F.least(equity * p.risk_pct / 100 / distance * close, equity * p.max_pos_pct / 100)
    else:
        value = equity / p.slots
    return lots(value, close, p.lot)


def auc_verdict(auc: Column) -> Column:
    """Fixed thresholds: 0.6, 0.55, 0.52, 0.48; no verdict without a number."""
    return F.when(~finite(auc), F.lit(None)).when(auc >= 0.6, "strong").when(auc >= 0.55, "useful").when(auc > 0.52, "weak").when(auc >= 0.48, "none").otherwise("inverted")


def model_verdict(test_auc: Column, val_auc: Column, low: Column) -> Column:
    """Three levels from the test and the validation AUC and the bootstrap's low bound of the gain; what is no number passes no
    threshold. Fixed thresholds: 0.52, 0.52 and above 0; then 0.51 and 0.5."""
    test_auc, val_auc, low = (guard(x) for x in (test_auc, val_auc, low))
    return F.when((test_auc >= 0.52) & (val_auc >= 0.52) & (low > 0), "better than the rules").when((test_auc >= 0.51) & (val_auc >= 0.5), "uncertain").otherwise("no edge")


def rank_words(rank: Column) -> Column:
    return F.when(rank >= 0.67, "high").when(rank <= 0.33, "low").otherwise("middle")


def percent_text(x: Column, digits: int = 1) -> Column:
    """Signed percentage; a dash for missing values."""
    return F.when(finite(x), F.format_string(f"%+.{digits}f%%", x * 100)).otherwise("-")


def contains_folded(query: str, *columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *columns)).contains(query.lower())
