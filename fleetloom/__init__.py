"""Fleet configuration analytics as Spark DataFrame operators.

Every public function takes and returns DataFrames (or Columns) and keeps no
state of its own; partitioning, joins and shuffles are left to Spark.
"""

import sys

from pyspark import cloudpickle

# Python functions run inside tasks travel with the job, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
