"""peakforge: mass-spectra analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
