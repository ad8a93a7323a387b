"""Training-data operators: decontamination, quality, archives, language, tokens, near and exact duplicates.

Nothing outside this subpackage imports it.
"""
