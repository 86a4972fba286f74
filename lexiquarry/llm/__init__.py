"""Corpus preparation: extraction, deduplication, filtering, mixing and vector search."""
