"""Spark-native exact Bayesian analysis of event rates, with batch, streaming, grid and hierarchy operators."""
