"""Log reduction that provably keeps every alert, on Spark."""
