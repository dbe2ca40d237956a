"""washkit: water, sanitation and utility-finance KPI operators on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame; the work runs as Spark
scans, joins, aggregates and windows. Sub-packages:

* ``sources``   typed loaders (CSV, JSON, GeoJSON, parquet), seed tables, sinks,
                and stand-in views built from the driver's TPC-H-style tables
* ``functions`` column expressions (derived columns) and predicates
* ``operators`` DataFrame -> DataFrame KPI operators
* ``plans``     the registered queries and their SQL oracles
* ``streaming`` the service time series over Structured Streaming
"""

__version__ = "0.1.0"
