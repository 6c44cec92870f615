"""sources of the decision-data engine."""
