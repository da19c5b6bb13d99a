"""Relational operators over alignments, trees, mutation histories and traces."""
