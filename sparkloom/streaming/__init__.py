"""Incremental forms of the step-log operators."""
