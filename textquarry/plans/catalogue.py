"""Every query of the library proper, with the SQL that says the same where SQL can."""

from . import evaluation, retrieval

QUERIES = retrieval.QUERIES | evaluation.QUERIES
SQL = retrieval.SQL | evaluation.SQL
