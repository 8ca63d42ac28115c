"""Operators of a training-data pipeline: archives, contamination, duplicates, quality, mixing, chat, licences, scoring.

Nothing else in the library imports this subpackage.  ``queries.QUERIES`` and ``queries.ORACLE_SQL`` hold what
``__spark_entry__.py`` registers.
"""
