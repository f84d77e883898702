"""Spark jobs for surveillance of clinical text."""
