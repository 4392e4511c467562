"""Structured Streaming forms of recipes, quality metrics, the event tail and session state."""
