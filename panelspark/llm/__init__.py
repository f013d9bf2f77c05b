"""Operators of a training-data pipeline: sharding, filters, joins, packing, scans, extraction.

Nothing else in the package imports this folder.
"""
