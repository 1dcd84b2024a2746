"""Scans with stable row identity, sinks, and the shared folder."""
