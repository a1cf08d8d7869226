"""Time-series, portfolio and corpus operators as PySpark DataFrame jobs."""
