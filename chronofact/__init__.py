"""chronofact: batch analytics over temporal fact stores, written for Spark."""
