"""Text functions on columns."""
