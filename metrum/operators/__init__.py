"""Operators by subject. Each is one DataFrame function keyed by the session column ``s``."""
