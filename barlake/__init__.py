"""barlake: bitemporal bar analytics and training-data operators on PySpark."""
