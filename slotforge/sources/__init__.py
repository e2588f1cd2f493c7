"""Landed files to typed tables, and tables to files."""
