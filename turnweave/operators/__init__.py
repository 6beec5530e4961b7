"""Joins and aggregations of transcripts."""
