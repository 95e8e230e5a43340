"""Part of the tessera engine: streaming."""
