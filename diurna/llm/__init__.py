"""Operators for building text training corpora.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only when it is present.
"""
