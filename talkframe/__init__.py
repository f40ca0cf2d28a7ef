"""Conversation analytics on Spark: segments, speakers, sides, values, archives, live sessions."""
