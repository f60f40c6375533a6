"""Structured Streaming: the same operators on micro-batches, plus keyed state."""
