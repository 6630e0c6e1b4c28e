"""Numbers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double in two halves of 26 bits.
_SPLIT = float((1 << 27) + 1)


def exact_round(value: Column, places: int = 0) -> Column:
    """The double nearest to a double's own (binary) value rounded to so many decimal places, ties to even.

    F.round rounds the shortest text of a double (2.675 is 2.68), this its value (2.67). The product with the power of
    ten is taken with its error, so ties are told exactly. Values whose scaled size is 2**52 or more stay as they are, as
    do NaN and infinities; places is 0 to 15.
    """
    if not 0 <= places <= 15:
        raise ValueError("places is 0 to 15")
    scale = float(10**places)
    value = value.cast("double")
    product = value * scale
    part = lambda x: (x * _SPLIT) - ((x * _SPLIT) - x)
    high, scale_high = part(value), scale * _SPLIT - (scale * _SPLIT - scale)
    low, scale_low = value - high, scale - scale_high
    error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    whole = F.floor(product).cast("double")
    over = (product - whole) - 0.5  # a multiple of the product's last place, so the error matters only where it is 0
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (F.pmod(whole, F.lit(2.0)) == 1.0))))
    rounded = (whole + F.when(up, 1.0).otherwise(0.0)) / scale
    small = F.abs(product) < float(1 << 52)
    return F.when(value.isNull() | F.isnan(value) | ~small, value).otherwise(rounded)
