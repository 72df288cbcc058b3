"""Fix-point loops and the cutting of lineage."""
