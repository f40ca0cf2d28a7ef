"""All registered queries."""

from talkframe.plans import archive_queries, live_queries, segment_queries, sound_queries, text_queries  # noqa: F401
from talkframe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
