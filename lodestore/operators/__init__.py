"""Part of the lodestore engine."""
