"""adledger: classified-ad pipelines as Spark DataFrame jobs."""
