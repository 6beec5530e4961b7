"""Scalar functions of transcripts as Column expressions."""
