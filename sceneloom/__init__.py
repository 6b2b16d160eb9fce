"""sceneloom: a Spark-first engine for finding, ranking and cleaning moments in video metadata."""

__version__ = "0.1.0"
