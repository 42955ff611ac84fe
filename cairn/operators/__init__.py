"""operators of cairn."""
