"""Quality and drift monitoring of batch scoring runs, as Spark DataFrame functions."""
