"""Whole flows: ingest, audit, reports, export, mutation, evaluation, and the queries over the synthetic tables."""
