"""Part of quarrylight."""
