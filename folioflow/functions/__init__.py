"""Column functions: scalars over text, cells and mathematical notation."""
