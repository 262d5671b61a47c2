"""No streaming in the reference: every read is a batch read.

The feature mart is a scheduled batch (days 1 and 16 of the month) whose
output is written with dynamic partition overwrite (``sources.tables.
write_partitioned``), so re-running one date replaces only that partition.
Nothing here is needed to reproduce the reference.
"""
