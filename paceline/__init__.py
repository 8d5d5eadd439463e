"""paceline: iterative, parameter-fitting analytics over dense numeric points on Spark."""
