"""Operators of a training-data pipeline: filters, deduplication, decontamination, scans, packing and token files."""
