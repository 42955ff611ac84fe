"""streaming of cairn."""
