"""Structured Streaming: sessions of live fixes and the scoring queue."""
