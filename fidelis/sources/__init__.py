"""Scans, sinks and the stand-in table bindings."""
