"""Reproducible uniforms in [0, 1): the first 32 bits of an md5 of the keys, the same in Spark and in SQL."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys) -> Column:
    text = F.concat_ws(":", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def uniform_sql(seed: int, *keys: str) -> str:
    text = " || ':' || ".join(f"({k})::varchar" for k in keys)
    return f"(('0x' || substr(md5({text} || ':{seed}'), 1, 8))::bigint / 4294967296.0)"
