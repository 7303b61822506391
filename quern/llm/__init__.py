"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it; its queries are listed in
:mod:`quern.llm.queries`.
"""
