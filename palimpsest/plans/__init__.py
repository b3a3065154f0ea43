"""Compositions of operators: recall, reasoning, extraction, consolidation."""
