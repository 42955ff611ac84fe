"""functions of cairn."""
