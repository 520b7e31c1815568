"""Training-data operators: dedup, fingerprints, extraction, language, scoring, encoding, mixing, quality.

Nothing outside this subpackage imports it; it can be deleted without affecting the rest of the library.
"""
