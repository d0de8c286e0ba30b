"""Document intake and field extraction at corpus scale, on Spark DataFrames.

``functions``  Column -> Column expressions (cleaning, fields, model responses, grids, quality)
``operators``  DataFrame -> DataFrame steps (admission, jobs, results, ledgers, status events)
``sources``    document files, job queue, status events, and their sinks
``streaming``  the same steps as Structured Streaming queries
``plans``      the registered queries over the given tables and their check SQL
"""

from docloom.session import get_session

__all__ = ["get_session"]
