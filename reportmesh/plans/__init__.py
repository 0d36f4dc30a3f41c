"""plans of the incident engine."""
