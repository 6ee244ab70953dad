"""Readers, writers, the snapshot catalogue and the mapping of benchmark tables to offers."""
