"""Streams: the same operators over Structured Streaming."""
