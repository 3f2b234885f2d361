"""matchlake: head-to-head match analytics and corpus preparation as Spark jobs."""
