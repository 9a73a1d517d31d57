"""Column helpers: scalars, session clocks and window scopes."""
