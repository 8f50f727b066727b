"""Functions of the evidence-retrieval engine."""
