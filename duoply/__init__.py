"""Reconciliation of sequences that several readers read, as Spark jobs."""
