"""Point-in-time market analytics and corpus preparation on Spark."""
