"""Registered queries of the corpus operators and their SQL."""

from barloom.llm.queries import audits, base, texts

QUERIES = {**base.QUERIES, **texts.QUERIES, **audits.QUERIES}
SQL = {**base.SQL, **texts.SQL, **audits.SQL}
