"""Column-expression builders: geometry, projection, scoring, identity, text."""
