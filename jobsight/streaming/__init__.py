"""Structured Streaming: job events (encode, sources, parse) and the live
job (per-batch tables, watermarked windows, summary)."""
