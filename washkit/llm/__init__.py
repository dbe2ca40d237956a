"""Training-data operators: sharding, packing, URL filtering, WARC, extraction, deduplication,
search, quality and decontamination. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Tasks carry this package's functions with them, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
