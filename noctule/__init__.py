"""Sky-camera observation analytics on Spark."""
