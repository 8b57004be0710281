"""Registered queries: each an operator over the test tables, with SQL of the same result where SQL has it."""
