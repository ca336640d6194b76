"""Site content as Markdown and agent traffic analysis, written as Spark jobs."""
