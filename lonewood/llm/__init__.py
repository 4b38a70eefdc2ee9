"""Operators of a training-data pipeline over the tables ``documents``, ``pages``,
``benchmark``, ``labels`` and ``conversations``.

Nothing else in the package imports this subpackage.  ``catalog`` registers one query per
operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
