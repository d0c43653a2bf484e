"""Lodestone: retrieval analytics expressed as Spark DataFrame transformations.

Documents, chunks, tokens, vectors, questions, rankings, judgements, packed
contexts and answers are all DataFrames; every operator maps DataFrames to
DataFrames over many documents and many queries at once.
"""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors do not
# need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
