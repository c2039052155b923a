"""Where tables come from and go to: schemas, versioned Parquet, generated fixtures, bindings."""
