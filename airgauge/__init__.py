"""Analytics for geolocated radio measurements, written as Spark DataFrame jobs."""
