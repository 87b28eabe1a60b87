"""Signal-panel analytics on Spark: dense time x instrument panels, formula evaluation, pools of return series."""
