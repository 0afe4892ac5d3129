"""Named queries over the test tables; each module has a Registry R."""

MODULES = ["annalist.plans.skew_queries", "annalist.plans.corpus_queries", "annalist.plans.cluster_queries", "annalist.plans.sequence_queries", "annalist.plans.stats_queries", "annalist.plans.catalog_queries", "annalist.plans.model_queries", "annalist.plans.more_queries", "annalist.plans.run_queries"]
