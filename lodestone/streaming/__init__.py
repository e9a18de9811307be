"""The same operators over Structured Streaming."""
