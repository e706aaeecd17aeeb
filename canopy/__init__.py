"""Structure and review analytics over node tables, written for Spark."""
