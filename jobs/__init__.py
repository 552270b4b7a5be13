"""Runnable jobs, each a command line around a function that takes a session; and their registered queries."""
