"""Broadcast of small objects whose classes the executors need not have installed."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcast ``value`` (of a size bounded by a parameter) pickled by value."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(sent: Broadcast):
    return pickle.loads(sent.value)
