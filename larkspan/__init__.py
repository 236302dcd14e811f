"""larkspan: corpus intelligence as Spark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame; nothing runs
until the caller acts on the result.
"""

__version__ = "0.1.0"
