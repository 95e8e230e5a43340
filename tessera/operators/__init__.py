"""Part of the tessera engine: operators."""
