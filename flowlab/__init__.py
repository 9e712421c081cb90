"""flowlab: network-flow analytics (labelling, features, evaluation, scoring,
alerting) expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
