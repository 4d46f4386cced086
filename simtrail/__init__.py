"""simtrail: multi-SIM scoring and mobility cohorts as Spark DataFrame operators."""

__version__ = "0.1.0"
