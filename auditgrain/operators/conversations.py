"""Conversation turns: recent context, transcripts and session lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditgrain.operators.ranking import top_k

TITLE_LENGTH = 120


def last_turns(turns: DataFrame, n: int = 12, session: str = "conv_id", sequence: str = "turn") -> DataFrame:
    """The last n messages of every session, numbered in reading order."""
    newest = top_k(turns, [session], [F.col(sequence).desc()], n, "_back")
    # At most n rows per session are left, so the second numbering is tiny.
    return top_k(newest, [session], [F.col(sequence)], n, "position").drop("_back")


def transcript(turns: DataFrame, session_id: object, session: str = "conv_id", sequence: str = "turn") -> DataFrame:
    """All messages of one session in order."""
    return turns.filter(F.col(session) == session_id).orderBy(sequence)


def recent_sessions(
    turns: DataFrame, limit: int = 100, session: str = "conv_id", activity: str = "last_activity", sequence: str = "turn"
) -> DataFrame:
    """Sessions by latest activity; the title opens the first user message."""
    opening = F.when(F.col("role") == "user", F.struct(F.col(sequence), F.substring("text", 1, TITLE_LENGTH)))
    sessions = turns.groupBy(session).agg(
        F.max(activity).alias("last_activity"), F.count("*").alias("messages"), F.min(opening).getField("col2").alias("title")
    )
    return sessions.orderBy(F.col("last_activity").desc(), session).limit(limit)
