"""Scans of raw source payloads: text as a source sent it, to typed rows and what was rejected."""
