"""votelake: Spark jobs that prepare, evaluate and report on content recommenders."""
