"""DataFrame operators of the factor engine."""
