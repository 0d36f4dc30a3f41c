"""streaming of the incident engine."""
