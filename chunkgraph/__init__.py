"""Code-graph analytics on Spark.

Column-parameterised DataFrame operators that turn a corpus of source files into a
chunk table and a call-graph edge table, retrieve a ranked two-bucket context for every
undocumented chunk, assemble prompt text, clean free-text responses, and apply line-range
edits to whole corpora. Every operator takes DataFrames and column names and returns a
DataFrame; nothing is collected to the driver.
"""

__version__ = "0.1.0"
