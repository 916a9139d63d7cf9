"""Reusable DataFrame operators: matches, interval joins, running totals, ranks."""
