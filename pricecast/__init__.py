"""pricecast: market price analytics and probabilistic forecasting on Spark DataFrames."""

__version__ = "0.1.0"
