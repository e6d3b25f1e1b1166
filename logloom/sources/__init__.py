"""Readers: log files to canonical tables, with malformed lines and unreadable files kept apart."""
