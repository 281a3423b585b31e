"""What the operators share: stored tables, free names, joins of skewed sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import Scope, Stored, new_folder, remove, shared_root

__all__ = ["Scope", "Stored", "free_name", "new_folder", "remove", "salted_join", "shared_root"]


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread_by: str, how: str = "inner", salts: int = 64) -> DataFrame:
    """Join a side in which one key may hold most rows with a side that has one row a key.

    ``many`` is dealt over ``salts`` parts of each key by a hash of ``spread_by``; the rows of ``one`` are repeated for
    each part. Nothing is broadcast, and no task gets more than a key's rows divided by ``salts``."""
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    left = many.withColumn("_salt", salt)
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
