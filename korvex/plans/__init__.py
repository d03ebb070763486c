"""Plan-level helpers: sessions, checkpoints, size-checked joins."""
