"""Operators for large text corpora: scoring, deduplication, licences, mixing, packing, page text and fingerprints."""
