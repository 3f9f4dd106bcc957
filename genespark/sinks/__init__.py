"""Writers for the exchange formats."""
