"""Equal contents under one name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions.scalars import content_token


def content_dedup(df: DataFrame, text: str, order: str) -> DataFrame:
    """One row per distinct text: its ``token``, the first ``order`` and the number of copies.

    The text is hashed whole in the scan and takes no part in the shuffle; copies of a hot
    text collapse before it.
    """
    return (
        df.select(F.col(order), content_token(F.col(text)).alias("token"))
        .groupBy("token")
        .agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    )
