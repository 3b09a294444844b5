"""Column masking with keyed tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import SpecError
from ..functions.text import hmac_token, shown


def mask(df: DataFrame, columns: list[str], salt: bytes | str | None) -> DataFrame:
    """Listed columns as tokens, the same for equal values; null stays null, absent columns are skipped."""
    if columns and not salt:
        raise SpecError("masking needs a salt")
    key = salt.encode() if isinstance(salt, str) else salt
    kinds = dict(df.dtypes)
    return df.withColumns({c: hmac_token(shown(df[c], kinds[c]), key) for c in columns if c in kinds})
