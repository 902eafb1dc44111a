"""Readers and the canonical telemetry view."""
