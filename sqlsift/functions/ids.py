"""Content identities as Catalyst expressions: UUIDv5 and SHA-1 without a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of all identities.
NAMESPACE = "018e1b50ee9873f29839420223323163"


def uuid5(text: Column) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), text.cast("binary")))
    variant = F.substring(F.lit("89ab"), ((F.instr(F.lit("0123456789abcdef"), F.substring(h, 17, 1)) - 1) % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def sha1_hex(text: Column) -> Column:
    return F.sha1(text.cast("binary"))


def uuid5_sql(text: str) -> str:
    """The same in DuckDB."""
    h = f"sha1(unhex('{NAMESPACE}') || cast({text} AS BLOB))"
    return f"(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||substr('89ab',((instr('0123456789abcdef',substr({h},17,1))-1)%4+1)::INT,1)||substr({h},18,3)||'-'||substr({h},21,12))"
