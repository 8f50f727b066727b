"""Plans of the evidence-retrieval engine."""
