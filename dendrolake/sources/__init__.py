"""Readers of sequence records, metadata and sampler logs."""
