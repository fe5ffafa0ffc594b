"""Operators of a training-data pipeline (quality, toxicity, near duplicates, token
counts, substring duplicates, packing, decontamination, vector search, licences,
personal data).  Nothing outside this package imports it."""
