"""Structured Streaming: guarded text streams, event-time windows, micro-batch upserts."""
