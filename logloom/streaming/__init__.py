"""Incremental scans: new log files become lines, findings and mergeable summaries, tick by tick."""
