"""Whole jobs: routing of classified responses, ingest, retention."""
