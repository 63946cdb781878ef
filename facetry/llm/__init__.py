"""Operators on training documents; nothing else in the package imports this one."""
