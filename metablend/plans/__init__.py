"""End-to-end plans (the study's notebook workflows as Spark jobs)."""
