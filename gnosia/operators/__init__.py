"""Relational operators over the edge table: closure, proofs, constraints, analytics."""
