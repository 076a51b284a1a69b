"""veta: data mining on Spark DataFrames for weighing, sensor, shipment and price data."""
