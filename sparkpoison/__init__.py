"""sparkpoison: DataFrame operators that look for poisoned data in tables of
documents, embeddings, tool schemas, lineage graphs and agent telemetry."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python tasks carry the functions they run, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
