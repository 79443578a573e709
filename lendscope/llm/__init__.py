"""Operators and the pipeline for preparing training data of language models.

Nothing else in the library imports this subpackage. Functions that run in
Python workers are pickled by value, and the package is shipped with the first
model that is broadcast (``common.share``), so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
