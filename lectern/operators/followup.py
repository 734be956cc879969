"""Replies to pending questions within a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def follow_up(turns: DataFrame) -> DataFrame:
    """turns (session, turn, text, asks) with `pending` (the text of the turn before, if that ended in a clarification, asks) and
    `query`: the pending question ahead of a reply to it."""
    before = Window.partitionBy("session").orderBy("turn")
    out = turns.withColumn("pending", F.when(F.lag("asks").over(before), F.lag("text").over(before)))
    return out.withColumn("query", T.compose(F.col("pending"), F.col("text")))
