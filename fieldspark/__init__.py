"""Field analytics on Spark: DataFrame operators for parcels, pixels, weather and yields."""
