"""Column functions for text, numbering and hashing."""
