"""Incremental versions of the accumulating operators over Structured Streaming. An extension: the surveyed work is batch."""
