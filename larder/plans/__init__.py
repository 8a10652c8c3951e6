"""Jobs that keep tables current, and the registry of named queries."""
