"""Live updates as Structured Streaming jobs."""
