"""Evidence analytics on Spark: ledgers, integrity checks, queues, exports and ingest as DataFrame plans."""
