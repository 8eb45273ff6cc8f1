"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it.  ``queries`` and ``oracle_sql`` in
``logweave.llm.registry`` hold the registered queries.
"""
