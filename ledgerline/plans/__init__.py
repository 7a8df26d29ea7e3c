"""The model of a domain, its routes, the plan and its alias tree: plain Python, no Spark."""
