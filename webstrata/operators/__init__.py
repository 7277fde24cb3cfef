"""Part of webstrata: operators."""
