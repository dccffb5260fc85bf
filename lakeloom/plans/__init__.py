"""Session, shared storage and row-level helpers."""
