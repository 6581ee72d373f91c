"""Training-data pipeline operators.  Nothing outside this subpackage imports it.

Functions that run inside Spark's Python workers are pickled by value, so an executor needs
numpy, pyarrow and the libraries an operator names, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
