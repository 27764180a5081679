"""codestrata: code-history analytics over many repositories, as DataFrame pipelines."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Tasks carry the package's few Python functions with them, so executors need no copy installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
