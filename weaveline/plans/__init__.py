"""Query registry over the driver's tables."""

from weaveline.plans import evaluation, graphs, inline, learned, pairs, references, textstats

_MODULES = [pairs, graphs, textstats, evaluation, inline, learned, references]

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}


def flagship(spark, sf_dir):
    return QUERIES["missing_links"](spark, sf_dir)
