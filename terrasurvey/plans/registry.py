"""All queries over the driver's tables, by name, and the SQL that gives the same rows."""

from importlib import import_module

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame and, where SQL can express it, its SQL."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def flagship(spark, sf_dir):
    return QUERIES["a05_measurements"](spark, sf_dir)


for _module in ("label_store", "measures", "ordered", "spatial", "scalars", "rasters", "routes", "streams", "extras", "ground", "shapes", "selection"):
    import_module(f"terrasurvey.plans.{_module}")
