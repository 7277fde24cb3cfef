"""Part of webstrata: plans."""
