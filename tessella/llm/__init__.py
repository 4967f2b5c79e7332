"""Training-data operators: near-duplicates, media, secrets, tokens, archives, decontamination, quality, chat.

Nothing outside this package imports it. Functions that run in Python workers are
pickled by value, so workers need the installed libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
