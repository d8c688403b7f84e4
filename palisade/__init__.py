"""palisade: governed analytics on Spark."""
