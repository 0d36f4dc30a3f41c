"""functions of the incident engine."""
