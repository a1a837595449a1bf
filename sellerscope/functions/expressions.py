"""Scalar column expressions (all JVM-side, codegen friendly; no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Reputation tier -> ordinal score used by the seller feature
# build.  Unknown tiers and NULL map to 0.
REPUTATION_SCORES = {
    "green_platinum": 5,
    "green_gold": 4,
    "green_silver": 4,
    "green": 3,
    "light_green": 3,
    "yellow": 2,
    "orange": 1,
    "red": 1,
    "newbie": 0,
}

# Alternative ordinal encoding declared in the saved
# recommendation output (five tiers; other tiers are unmapped -> default 0).
REPUTATION_SCORES_ALT = {
    "newbie": 1,
    "green_silver": 2,
    "green_gold": 3,
    "green": 4,
    "green_platinum": 5,
}


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """Division that yields NULL (not an ANSI error) on a zero or NULL divisor."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def lookup(c, mapping: dict, default=None, value_type: str = "double") -> Column:
    """Map a string column through a fixed dictionary (a literal map, no join)."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v).cast(value_type)]
    m = F.create_map(*pairs)
    out = F.element_at(m, col_(c))
    # element_at on a map returns NULL for a missing key (also under ANSI for maps)
    return F.coalesce(out, F.lit(default).cast(value_type)) if default is not None else out


def reputation_score(c="seller_reputation", mapping: dict | None = None) -> Column:
    return lookup(c, mapping or REPUTATION_SCORES, default=0.0)


def discount_pct(price="price", regular="regular_price") -> Column:
    """(regular - price) / regular; 0 when regular is NULL or 0; NULL when only price is NULL."""
    r = col_(regular)
    return (F.when(r.isNull() | (r == 0), F.lit(0.0))
             .otherwise(F.try_divide(r - col_(price), r)))


def text_length(c) -> Column:
    """Length in characters (code points)."""
    return F.length(col_(c)).cast("double")


def indicator(cond: Column) -> Column:
    """1.0 / 0.0 double (a NULL condition counts as 0.0, like pandas' == on NaN)."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


SNAP_SHIFT = 1.5 * 2 ** 52  # adding and taking away this double rounds to the nearest whole number, ties to even


def snap(c, bits: int = 20) -> Column:
    """Round to the binary grid 2^-bits, ties to even; values of 2^(51-bits) and more stay as they are.

    Used when comparing results across engines whose sums differ in the last
    bits.  All steps are additions and multiplications of doubles, so equal
    inputs give equal outputs in any engine and nothing saturates; and because
    the grid is binary, an average of decimal data (k / (100 n)) can only sit
    exactly on a rounding midpoint when n has a factor 2^(bits-1), which a
    decimal grid hits at n = 32 already.
    """
    f = float(2 ** bits)
    x = col_(c).cast("double")
    near = (x * F.lit(f) + F.lit(SNAP_SHIFT) - F.lit(SNAP_SHIFT)) / F.lit(f)
    return F.when(F.abs(x) < F.lit(float(2 ** (51 - bits))), near).otherwise(x)


def round_doubles(df: DataFrame, bits: int = 20, exclude=(), bits_of: dict | None = None) -> DataFrame:
    """Snap every double column to a 2^-bits grid (see ``snap``); ``bits_of`` names columns with another grid."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in exclude:
            out.append(snap(f.name, (bits_of or {}).get(f.name, bits)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
