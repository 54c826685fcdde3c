"""Readers and writers: delimited and fixed-width text, extracts, sinks, dataset catalogue."""
