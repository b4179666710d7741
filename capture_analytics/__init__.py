"""Spark-native analytics over captured web pages, job posts, run traces and chats."""

import sys

from pyspark import cloudpickle

from capture_analytics.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]

# The few Python helpers travel inside their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
