"""Spark jobs over recorded coding-agent sessions.

``sources``    read session files and normalise each layout into typed tables
``functions``  Column -> Column helpers and the fixed vocabularies
``operators``  DataFrame -> DataFrame operators
``plans``      end-to-end batch jobs built from the operators
``streaming``  Structured Streaming versions of the ingest jobs
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
