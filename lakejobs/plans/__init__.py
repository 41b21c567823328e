"""Registered queries: each operator run over views of the given tables, with its SQL twin."""

from lakejobs.plans import air, catalogs, files, grids, layouts, models, reviews, versions, weather

MODULES = (weather, reviews, air, files, layouts, grids, versions, catalogs, models)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}
