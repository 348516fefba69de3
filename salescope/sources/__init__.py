"""Readers: invoice CSV batches, stored star tables and the test-data adapters."""
