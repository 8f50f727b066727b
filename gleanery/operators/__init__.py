"""Operators of the evidence-retrieval engine."""
