"""Compositions of operators: scenarios, generation, bundles, queries, command line."""
