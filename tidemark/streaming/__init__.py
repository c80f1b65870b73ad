"""Streaming forms of the operators (an extension: the batch operators are the reference)."""
