"""Every operator run over the given tables, with the equivalent SQL where one exists."""

from queries import fits, grid, layers, match, merge, scalar, walk

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for module in (scalar, match, fits, walk, layers, grid, merge):
    QUERIES.update(module.QUERIES)
    ORACLE.update(module.ORACLE)
