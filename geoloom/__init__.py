"""Feature-table export and file-collection snapshots as Spark jobs."""
