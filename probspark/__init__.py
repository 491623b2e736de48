"""probspark: probability, panel and text operators as Spark jobs."""
