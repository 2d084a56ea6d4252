"""Operators of a training-data pipeline: filters, deduplication, decontamination and mixing over ``documents``.

Nothing else in the library imports this subpackage; its queries are registered by ``queries.py``.
"""
