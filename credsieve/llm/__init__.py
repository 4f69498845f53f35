"""Training-data operators: classifiers, joins, search, packing, sharding, mixing and secret scans."""
