"""Reversible de-identification of text at scale, written as Spark plans.

Subpackages

* ``functions``  scalar column expressions (codecs, placeholder grammar, MACs)
* ``operators``  detection, interning, masking, rehydration, policy, reports, audit
* ``sources``    rule sets, term lists, exchanges, event streams, vault tables, logs
* ``plans``      composed jobs over whole tables
* ``streaming``  Structured Streaming forms of masking and rehydration
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions that run in tasks travel with the plan, so workers
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
