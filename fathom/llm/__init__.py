"""Training-data operators: thirteen methods over documents, pages and embeddings.

Nothing else in the library imports this subpackage. ``queries`` registers
one query per operator; the operators themselves keep general interfaces.
"""
