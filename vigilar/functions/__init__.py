"""Column-level building blocks: null policy, text, levels, formats, tail functions."""
