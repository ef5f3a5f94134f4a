"""Column functions: normalisation, features, and formatting."""
