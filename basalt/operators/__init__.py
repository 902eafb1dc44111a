"""Versioned table layer and dataflow operators."""
