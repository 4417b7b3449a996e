"""Runnable jobs over the given tables; each module has a function that takes a session, and a command line."""
