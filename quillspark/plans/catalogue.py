"""Named queries over the driver's tables, each with its SQL oracle where SQL can say the same."""

from quillspark.plans import citations, manuscripts, results, reviews, sections, sources, voting

_MODULES = (voting, results, citations, sources, manuscripts, sections, reviews)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
