"""quirefold: document, notation and corpus analytics as Spark DataFrames."""
