"""Training-data operators: dedup, decontamination, scoring, packing, archives.

Nothing else in the library imports this subpackage.
"""
