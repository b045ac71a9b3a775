"""Structured Streaming: event counts, sessions and the stateful guard."""
