"""Document reconciliation, inventory and content analytics on Spark DataFrames."""
