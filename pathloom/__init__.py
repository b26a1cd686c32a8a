"""pathloom: file, asset and package metadata tables as Spark jobs.

Every operator takes and returns DataFrames (or builds a Column), so jobs are written as
chains of ``df.transform(...)`` and planned by Catalyst as one query.
"""

__version__ = "0.1.0"
