"""Time-series analytics on Spark tables.

Every table that enters an ordered operator is a *numbered* table: it has
``series_id``, ``ts`` (timestamp without zone) and ``pos``, the 1-based position
of the row in its series.  ``plans.blocks`` explains why.
"""
