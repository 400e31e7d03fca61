"""Writing finished tables."""
