"""Incident intelligence over geo-tagged, time-stamped text reports, as Spark jobs."""

__version__ = "0.1.0"
