"""All registered queries and their SQL."""

from procwatch.plans import datasets, governance, knowledge, learning, models, remedies, signals, streams

_MODULES = (signals, learning, governance, knowledge, remedies, datasets, models, streams)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: text for module in _MODULES for name, text in module.ORACLES.items()}
