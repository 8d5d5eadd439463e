"""Training-data operators: sampling, similarity, token encoding, mixing and splitting.

Nothing else in the library imports this subpackage.
"""
