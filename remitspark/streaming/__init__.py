"""Incremental runs of the file scans."""
