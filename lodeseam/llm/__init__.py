"""Operations of a training-data pipeline: dedup, search, packing, extraction, tokenising, sharding.

Nothing else in the library imports this subpackage. ``queries.QUERIES`` and ``queries.ORACLE_SQL``
list what ``__spark_entry__.py`` registers.
"""
