"""Training-data operators (license scan, de-duplication, mixing, tokens, decontamination).

Nothing else in the library imports this subpackage.
"""
