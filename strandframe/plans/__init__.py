"""Registered queries: every operator on views of the given tables."""


def load_catalog():
    """Import all query modules and return the catalog."""
    from strandframe.plans import catalog
    from strandframe.plans import (  # noqa: F401
        cluster_queries,
        interval_queries,
        matrix_queries,
        motif_queries,
        sequence_queries,
        source_queries,
        stats_queries,
    )

    return catalog
