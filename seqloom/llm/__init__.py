"""Operators for preparing training data for language models.

Nothing outside this folder imports it.  ``queries()`` and ``oracle_sql()``
(in ``seqloom.llm.queries``) register one query for each operator.
"""
