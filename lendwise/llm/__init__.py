"""Training-data operators: URL filter, decontamination, secret scan, packing, WARC, near-duplicate join, quality
classifier, token counts, language ID and exact vector search. Nothing else in the library imports this package.

Task functions of this package are shipped by value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
