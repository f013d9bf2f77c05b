"""The analyses.  Contract: a panel has one row per (entity, year), keys are not NULL.

With that contract a window or a collected array holds at most one element per year of one
entity, whatever the number of rows the panel was aggregated from.
"""
