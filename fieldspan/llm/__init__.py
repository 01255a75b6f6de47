"""Training-data operators: sharding, licence scan, decontamination, WARC, quality rules,
token counts, near-duplicate join, line dedup, personal data, and source mixing.

Nothing outside this package imports it; it may be removed as a whole."""
