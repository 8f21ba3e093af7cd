"""Versioned, time-ranged data panels as PySpark DataFrame operators.

A *panel* is a table of blocks: one row per node, attribute, scenario, time range
and chunk, each with a version.  The package builds grids, reads the latest version
of every key, looks back in time without seeing the future, merges keyed tables and
runs user functions per cell, all as lazy DataFrame plans.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need not have the package installed: its few Python helpers travel with the
# functions that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
