"""Helpers on plans: lineage and what reached the scan."""
