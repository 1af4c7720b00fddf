"""Readers and writers: topic logs, snapshot tables, OLTP tables and logs."""
