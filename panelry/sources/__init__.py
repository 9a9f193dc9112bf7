"""Reading and writing of ticks, bars, caches and results, and the adapters over the given tables."""
