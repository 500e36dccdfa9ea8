"""Crawl-corpus analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Ship the few Python helpers with the tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
