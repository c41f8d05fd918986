"""Regression, validation, kriging, segmentation and anomaly scoring on Spark ML."""
