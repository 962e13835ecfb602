"""slotcast: airtime-sales analytics as Spark jobs.

Every operator is a function from DataFrame to DataFrame.  See README.md for the map from
operator ids to modules.
"""

__version__ = "0.1.0"
