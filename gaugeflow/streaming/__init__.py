"""Structured Streaming forms of the operators, and the pipeline that joins them."""
