"""paperlake: document-evidence analytics as Spark jobs."""
