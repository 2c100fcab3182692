"""Operators of a training-data pipeline: token counts, packing, repeated
passages, quality scores and rules, byte-level BPE, revisit records, near
duplicates of texts and vectors, chat formatting.

Nothing else in the library imports this subpackage.
"""
