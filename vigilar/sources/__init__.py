"""Typed inputs and result files."""
