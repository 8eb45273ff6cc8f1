"""Keep tables equal by replaying change logs, with Spark DataFrames."""
