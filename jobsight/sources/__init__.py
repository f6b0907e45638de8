"""Readers: scraper CSV files, documents, record counts, delimiter sniffing,
and raw inputs derived from the driver tables (testbed)."""
