"""Inputs and outputs: tables, files, Kafka."""
