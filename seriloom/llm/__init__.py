"""Training-data operators: tokens, near-duplicates, toxicity, quality, search, secrets, language, archives, mixing.

Functions of this subpackage run inside Python workers. They are pickled by value, so the workers
need no installed copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
