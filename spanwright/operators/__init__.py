"""Relational operators over traces, spans, cases, results and findings."""
