"""Change streams on Structured Streaming."""
