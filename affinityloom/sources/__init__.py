"""Scans, normalisers and sinks."""
