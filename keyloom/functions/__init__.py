"""Part of keyloom."""
