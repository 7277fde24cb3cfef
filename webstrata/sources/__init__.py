"""Part of webstrata: sources."""
