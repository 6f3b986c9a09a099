"""Composed jobs, serving tables and the registered queries."""
