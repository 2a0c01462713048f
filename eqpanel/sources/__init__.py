"""Scans, sinks and payload decoders."""
