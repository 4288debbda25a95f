"""dropledger: a Spark catalogue and merge engine for monthly ZIP/CSV data drops."""
