"""Training-data operators: scoring, deduplication, decontamination, extraction, mixing.

Nothing else in the package imports this subpackage.
"""
