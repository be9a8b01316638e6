"""Operators for preparing training text: cleaning, near duplicates, tokens, mixing, scoring.

Nothing outside this subpackage imports it. Every operator takes a DataFrame with an id and
a text column and returns a lazy DataFrame; intermediate tables that an operator must store
go to the shared folder the session names in ``spark.checkpoint.dir``.
"""
