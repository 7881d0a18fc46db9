"""Registered queries with their oracles, by group of operators."""

from duoply.plans import columns, corpora, linkage, live, readings, sequences

FLAGSHIP = "jn01_merge_two_readings"
QUERIES = {k: f for m in (columns, readings, linkage, sequences, corpora, live) for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in (columns, readings, linkage, sequences, corpora, live) for k, s in m.ORACLES.items()}
