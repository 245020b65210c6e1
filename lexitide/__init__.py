"""lexitide: analytics over dated text collections, as Spark DataFrame and Spark ML jobs."""
