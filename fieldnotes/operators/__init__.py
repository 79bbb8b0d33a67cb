"""The analysis operators."""
