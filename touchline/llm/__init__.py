"""Operators for building training corpora (documents, vectors, web pages).

Nothing outside this package imports it; ``queries`` holds the registered
queries and their SQL, ``corpus_pipeline.py`` chains five of the operators.
"""
