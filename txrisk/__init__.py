"""Account-risk analytics on ledger transactions, as Spark DataFrame jobs."""
