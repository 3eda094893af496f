"""Training-data operators: ten document, page and vector jobs and their registered queries.

Nothing outside this package imports it. ``registry.queries()`` and ``registry.oracle_sql()`` are what
``__spark_entry__.py`` adds when the package is present.
"""
