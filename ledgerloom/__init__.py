"""Ledger analytics as composable DataFrame operators."""
