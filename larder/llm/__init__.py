"""Operators for training-data work: matching, linkage, survivorship, packing, leakage and abuse scoring."""
