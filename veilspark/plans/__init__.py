"""Relational operators over spans: joins of intervals, choice, clusters, groups."""
