"""loomlog: session-log analytics written as Spark jobs."""
