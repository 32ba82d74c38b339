"""Training-data operators for corpora that do not fit one machine.

Nothing outside this subpackage imports it; queries are in ``provena.llm.queries``.
"""
