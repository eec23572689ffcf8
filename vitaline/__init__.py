"""vitaline: longitudinal patient-event analytics on Spark DataFrames."""
