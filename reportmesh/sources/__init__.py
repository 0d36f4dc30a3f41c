"""sources of the incident engine."""
