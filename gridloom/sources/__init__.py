"""Storage and exchange formats."""
