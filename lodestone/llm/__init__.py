"""Training-data operators over large document tables, and their queries."""


def registered():
    """Queries of this subpackage and the SQL of those that have an oracle."""
    from . import queries

    return dict(queries.QUERIES), dict(queries.ORACLES)
