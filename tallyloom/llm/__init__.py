"""Corpus operators for training data: dedup, classifiers, filters, packing, scans and media columns."""
