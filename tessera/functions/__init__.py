"""Scalar semantics and small expression languages, all compiled to columns."""
