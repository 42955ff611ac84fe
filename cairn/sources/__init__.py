"""sources of cairn."""
