"""Column expressions: transforms, projections, distances and vector arithmetic."""
