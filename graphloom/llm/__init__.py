"""Training-data operators: dedup, decontamination, filtering, packing, extraction.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
