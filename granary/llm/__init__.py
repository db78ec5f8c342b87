"""Training-data operators: ten self-contained DataFrame operators and their queries.

Nothing outside this package imports it; ``__spark_entry__.py`` adds
:func:`granary.llm.registry.queries` only when the package is present.
"""
