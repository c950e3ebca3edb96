"""Sky-coverage analytics on Spark: HEALPix cell algebra, coverage sets, lookups and rollups as DataFrame plans."""
