"""All registered queries outside the optional subpackage."""

from __future__ import annotations

from cladeflow.plans import problems, records, trees, vectors

MODULES = (problems, records, vectors, trees)


def entry(spark, sf_dir):
    return problems.p3_found(spark, sf_dir)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: text for m in MODULES for name, text in m.SQL.items()}
