"""Knowledge-graph retrieval and evaluation over text chunks, as Spark DataFrame plans."""
