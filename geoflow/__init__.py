"""geoflow: post-disaster geospatial mapping as Spark DataFrame jobs."""
