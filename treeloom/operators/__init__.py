"""Tree operators on node tables."""
