"""Conversational-corpus analytics on Spark: declarative operators for threaded posts and chat records."""
