"""salescope: retail invoice cleaning, star-schema loading and sales rankings on Spark.

Every public function maps ``DataFrame -> DataFrame`` (or a small tuple of
DataFrames) and stays lazy: nothing is collected to the driver.
"""

from salescope.star_schema import Star

__all__ = ["Star"]
