"""Training-data operators: license scans, near-duplicate removal, PII surrogates, substring
deduplication, sharding, HTML text extraction, quality scoring, source mixing, benchmark
decontamination and nearest-neighbour search.

Nothing else in the package imports this subpackage.
"""
