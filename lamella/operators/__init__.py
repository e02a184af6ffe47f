"""Set operators over mutation logs: reconciliation, reads, the log, runs and compaction."""
