"""quaymind: retail customer-support analytics as Spark DataFrame jobs.

Tables of messages, catalogs, vectors and vocabularies go in; DataFrames
come out.  Every operator is a function from DataFrames (and column
expressions) to a DataFrame, so Catalyst sees one plan per job.
"""

__version__ = "0.1.0"
