"""Transformations of reads: validation, filters, samples, metrics, pairs and line parsing."""
