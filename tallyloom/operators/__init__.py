"""DataFrame operators of the reconciliation engine."""
