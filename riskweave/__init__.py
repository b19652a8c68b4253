"""riskweave: financial-crime analytics as plain Spark DataFrame functions.

Every operator takes DataFrames and returns a DataFrame, so the caller decides
where data comes from and where it goes.  Nothing runs until the caller asks.
"""

from riskweave.settings import Settings

__all__ = ["Settings"]
