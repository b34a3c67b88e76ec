"""Lattix: keyed state, queues, matrices, balancing and models as Spark DataFrame operators."""
