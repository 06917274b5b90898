"""Compositions of operators: jobs, evaluators and the registered queries."""
