"""Content- and pipeline-analytics operators expressed as Spark DataFrame functions."""
