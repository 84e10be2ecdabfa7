"""Column functions over cross-sections."""
