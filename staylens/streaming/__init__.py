"""Structured Streaming entry points (the cleaning steps are stateless projections and filters,
so a fitted cleaner applies to a stream unchanged; deduplication becomes streaming state)."""

from staylens.streaming.clean import clean_stream, start_clean_stream  # noqa: F401
