"""Operators on documents: spans, rewriting, criteria, rules, search sessions."""
