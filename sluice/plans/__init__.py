"""User-level queries composed from the operators."""
