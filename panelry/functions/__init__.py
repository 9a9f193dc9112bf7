"""Column expressions: rolling windows with zero padding, cross-section ranks, robust scaling."""
