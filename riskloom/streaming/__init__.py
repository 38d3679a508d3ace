"""Structured Streaming forms of the monitors and alert rules."""
