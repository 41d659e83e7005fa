"""Graph queries: text to algebra to DataFrame."""
