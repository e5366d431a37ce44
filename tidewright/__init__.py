"""Spark-native analytics for time series, states, packets and forecasts."""
