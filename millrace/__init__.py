"""Millrace: analytics and data-processing operators written as Spark DataFrame jobs."""
