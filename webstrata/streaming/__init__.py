"""Part of webstrata: streaming."""
