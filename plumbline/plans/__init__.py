"""Reconciliation jobs: checks, source rebuild, variance reports, transactions, suite runner."""
