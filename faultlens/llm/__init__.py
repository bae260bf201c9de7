"""Training-data operators: thirteen corpus operators, each usable on any DataFrame of documents, pages or vectors.

Nothing else in the package imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# task functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
