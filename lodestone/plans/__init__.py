"""Plan-level helpers: materialised cut points and size checks."""
