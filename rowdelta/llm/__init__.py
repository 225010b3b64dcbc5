"""Training-data operators: deduplication, language id, scans, formatting, scoring, mixing.

Nothing outside this subpackage imports it.
"""
