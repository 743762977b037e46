"""Structured Streaming jobs: answers from deltas, index upkeep, index status."""
