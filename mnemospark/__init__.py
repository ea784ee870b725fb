"""Archive search, observation analytics and corpus preparation as Spark jobs."""
