"""Spark DataFrame operators for daily market data and the text around it."""
