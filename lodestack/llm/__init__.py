"""Training-data operators: formatting, deduplication, scoring, scans, packing and binary output.

Nothing outside this subpackage imports it.
"""
