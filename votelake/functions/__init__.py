"""Part of votelake."""
