"""Training-data operators: fingerprints, scoring, de-duplication, tokenisation and privacy.

Nothing else in the library imports this subpackage.
"""
