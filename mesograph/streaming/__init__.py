"""Edge lists that grow while they are read."""
