"""tidelog: analytics over replicated key-value mutation logs, as Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame.  Nothing here
imports the optional subpackage ``tidelog.llm``.
"""

__version__ = "0.1.0"
