"""Part of the tessera engine: plans."""
