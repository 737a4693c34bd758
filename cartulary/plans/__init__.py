"""Operator chains, reports and document sinks."""
