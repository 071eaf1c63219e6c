"""Coverage analytics for streams of short documents, as DataFrame-in / DataFrame-out Spark jobs."""
