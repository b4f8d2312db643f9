"""Behaviour analytics on Spark: activity logs in, ranked anomaly alerts out.

Every operator takes DataFrames and returns DataFrames; nothing row-scale
passes through the driver.
"""

__version__ = "0.1.0"
