"""Site-observation analytics on Spark: detections compared with a plan, as DataFrame operators."""
