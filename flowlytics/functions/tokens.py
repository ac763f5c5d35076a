"""Behaviour tokens: text form, packed id and the domain clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlytics.functions.values import (
    CHANNEL_NAMES, DIRECTION_NAMES, RISK_NAMES, TYPE_NAMES, label_of, winsorise,
)

# Legal range of each token field (lowest, highest).
FIELD_RANGE = {
    "direction": (0, 1),
    "amount_bin": (0, 15),
    "product_type": (0, 5),
    "risk_level": (1, 5),
}


def bin_label(number: Column) -> Column:
    """A00, A01, ...; a missing bucket (-1) prints as A-1."""
    number = number.cast("int")
    return F.concat(F.lit("A"), F.when(number < 0, number.cast("string"))
                    .otherwise(F.format_string("%02d", number)))


def compose_token(direction, amount_label, product_type, risk) -> Column:
    """DIR_Axx_TYPE_Rn; unknown codes print as UNK."""
    return F.concat_ws(
        "_",
        label_of(direction, DIRECTION_NAMES),
        amount_label,
        label_of(product_type, TYPE_NAMES),
        label_of(risk, RISK_NAMES),
    )


def compose_wide_token(token, dow, hour_label, gap_label, channel=None) -> Column:
    """The eight-field comparison token; NA where there is no channel column."""
    channel_text = F.lit("NA") if channel is None else label_of(channel, CHANNEL_NAMES)
    return F.concat_ws(
        "_", token, channel_text,
        F.concat(F.lit("D"), dow.cast("string")), hour_label, gap_label,
    )


def clamp_field(name: str, col: Column | str) -> Column:
    lo, hi = FIELD_RANGE[name]
    return winsorise(col, lo, hi)


def pack_token(direction="direction", amount_bin="amount_bin",
               product_type="product_type", risk="risk_level") -> Column:
    """One integer in 0..959 from the four clamped fields."""
    d = clamp_field("direction", direction)
    a = clamp_field("amount_bin", amount_bin)
    p = clamp_field("product_type", product_type)
    r = clamp_field("risk_level", risk)
    return (((d * 16 + a) * 6 + p) * 5 + (r - 1)).cast("int")
