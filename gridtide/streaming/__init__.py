"""Period-by-period appends and Structured Streaming jobs."""
