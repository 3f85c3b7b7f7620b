"""Live panels on Structured Streaming."""
