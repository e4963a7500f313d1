"""Micro-batches."""
