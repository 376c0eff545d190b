"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it. The registered queries and their
SQL twins are in :mod:`paraloom.llm.queries`.
"""
