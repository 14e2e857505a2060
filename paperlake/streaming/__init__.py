"""Structured Streaming: stateful operators by session, and runs over a table's files as they are now."""
