"""streaming of the decision-data engine."""
