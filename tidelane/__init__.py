"""Spark jobs for published tide and tidal-current predictions and event series shaped like them."""
