"""operators of the incident engine."""
