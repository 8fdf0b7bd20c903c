"""loomwork: keyed-text data processing as PySpark DataFrame plans.

``sources`` read and write, ``functions`` build column expressions, ``operators``
take DataFrames and return DataFrames, ``plans`` bind the operators to tables as
named queries, ``streaming`` holds Structured Streaming jobs and ``llm`` the
training-data operators, which nothing else imports.
"""

import sys

from pyspark import cloudpickle

# Functions travel to Python workers by value: no executor needs this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
