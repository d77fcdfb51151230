"""granary: document retrieval and grounded answers as Spark jobs."""
