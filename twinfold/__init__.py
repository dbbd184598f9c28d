"""twinfold: record matching on Spark DataFrames.

Clean messy records, propose candidate pairs through blocking keys, score the
pairs with a logistic model, group the matches, link new records to a table
and profile the data.  Every operator takes and returns a DataFrame or Column.
"""

import sys

from pyspark import cloudpickle

# The batch functions travel to the executors by value: no package has to be
# installed or shipped there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
