"""plans of the decision-data engine."""
