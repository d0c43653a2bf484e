"""All registered queries over the given tables and their SQL oracles."""


def registered():
    from . import answers, ranking, search, texts  # noqa: F401
    from .base import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
