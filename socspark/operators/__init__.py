"""Jobs over normalised events."""
