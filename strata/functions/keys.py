"""Surrogate keys: 64-bit signed fingerprints of business codes.

The fingerprint is the first 16 hex digits of MD5 read as an unsigned number, minus 2^63, so it
fits a signed bigint; NULL in gives NULL out (unlike ``xxhash64``, which maps NULL to 42).
Everything stays a built-in expression, so it runs inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIGN_BIT = -(2 ** 63)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fingerprint64(c) -> Column:
    """Signed 64-bit fingerprint of a string column."""
    hex16 = F.substring(F.md5(_c(c).cast("string")), 1, 16)
    # the 64 bits read as signed; less 2^63 is the same bits with the sign bit flipped, without decimals
    return F.conv(hex16, 16, -10).cast("bigint").bitwiseXOR(F.lit(_SIGN_BIT))


def product_key(toy="TOY_NO", dash="DASH_CODE") -> Column:
    """Fingerprint of ``TOY_NO-DASH_CODE``; NULL in either half gives NULL."""
    return fingerprint64(F.concat(_c(toy), F.lit("-"), _c(dash)))


def calendar_key(d="CALENDAR_DATE") -> Column:
    """Fingerprint of ``year || ISO date``."""
    d = _c(d)
    return fingerprint64(F.concat(F.year(d).cast("string"), d.cast("string")))


def composite_hash(cols: list[str]) -> Column:
    """Fingerprint of a struct of the key columns rendered as JSON, NULL fields kept."""
    return fingerprint64(F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"}))


def delimited_hash(cols: list[str], sep: str = "|") -> Column:
    """P4 variant with an engine-neutral rendering: ``concat_ws`` of the values, NULL as ``\\N``."""
    return fingerprint64(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols]))


def row_hash(df: DataFrame, exclude: list[str] | None = None) -> Column:
    """Fingerprint of every non-ADMIN column of ``df``."""
    skip = set(exclude or [])
    cols = [c for c in df.columns if not c.startswith("ADMIN_") and c not in skip]
    return composite_hash(cols)
