"""Part of the tessera engine: sources."""
