"""hexloom: geospatial hexagon analytics as DataFrame-to-DataFrame transformations on Spark."""
