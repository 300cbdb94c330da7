"""Structured Streaming forms of operators whose batch form is ordered."""
