"""Distance-matrix analytics on Spark: address text, geocoding, road graphs, routing, table synchronisation, limits, accuracy panels."""
