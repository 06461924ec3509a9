"""Dependency-ordered table loads on Spark: select, check, merge, reconcile."""
