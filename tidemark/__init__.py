"""Point-in-time, cross-sectional and portfolio analytics as PySpark DataFrame jobs."""
