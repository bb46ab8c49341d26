"""Runnable jobs over the library; each file has a function taking a session, and a command line."""
