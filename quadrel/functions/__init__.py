"""Column functions of text analysis and naming."""
