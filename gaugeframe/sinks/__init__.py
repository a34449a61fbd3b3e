"""Reports of points, findings and tables."""
