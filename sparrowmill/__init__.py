"""sparrowmill: UI-trace, dataset-building and evaluation analytics as Spark jobs."""
